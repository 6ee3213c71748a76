"""Shape validation and corpus preparation on Spark DataFrames."""

from .api import (
    lint_data_graph,
    lint_graph,
    lint_shapes_graph,
    parse_shapes_graph,
    validate,
    validate_graphs,
    validate_graphs_conforms,
    validate_shape,
    validate_triples,
)
from .graph import Dataset, Graph, Iri, Literal, MappedGraph, Mapping, TripleGraph
from .plans.compile import register_component
from .plans.ir import Shape
from .plans.mode import COMPAT, STRICT, Mode
from .plans.shapes import parse_shape, parse_shapes
from .report import Report

__all__ = [
    "COMPAT", "STRICT", "Dataset", "Graph", "Iri", "Literal", "MappedGraph", "Mapping", "Mode", "Report", "Shape",
    "TripleGraph", "lint_data_graph", "lint_graph", "lint_shapes_graph", "parse_shape", "parse_shapes",
    "parse_shapes_graph", "register_component", "validate", "validate_graphs", "validate_graphs_conforms",
    "validate_shape", "validate_triples",
]
