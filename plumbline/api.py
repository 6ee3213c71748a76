"""Entry points: parse shapes, validate graphs, lint texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .graph import Dataset, Graph, Triple
from .plans.compile import Compiler
from .plans.ir import Shape
from .plans.mode import STRICT, Mode
from .plans.shapes import ShapeError, parse_shapes
from .report import Report
from .sources.readers import BASE, ParseError, quads_of, read_graph, read_triples


def validate(graph: Graph | Dataset, shapes: Iterable[Shape], mode: Mode = STRICT, details: bool = False) -> Report:
    """The report of ``shapes`` over ``graph``: one plan, in which equal targets share theirs, though a scan may be read for
    each. ``details`` keeps the results of the shapes inside sh:node, sh:and, sh:or and sh:xone as well."""
    dataset = graph if isinstance(graph, Dataset) else Dataset(graph)
    compiler = Compiler(dataset, mode)
    compiler.details = [] if details else None
    found: list[DataFrame] = [compiler.validate(s) for s in shapes]
    return Report(reduce(DataFrame.unionByName, found) if found else compiler.none(), compiler.details or ())


def validate_shape(graph: Graph, shape: Shape, mode: Mode = STRICT) -> Report:
    return validate(graph, [shape], mode)


def validate_triples(graph: Graph, shapes: Iterable[Triple], mode: Mode = STRICT, details: bool = False) -> Report:
    """The report of a parsed shapes graph, which SPARQL constraints can then name."""
    shapes = list(shapes)
    return validate(Dataset(graph, shapes), parse_shapes(shapes, mode), mode, details)


def validate_graphs(
    spark: SparkSession, data: str, shapes: str, data_format: str = "ttl", shapes_format: str = "ttl", output: str = "text", mode: Mode = STRICT
) -> str:
    """The rendered report of two texts."""
    return validate_triples(read_graph(spark, data, data_format), read_triples(shapes, shapes_format), mode).render(output)


def validate_graphs_conforms(spark: SparkSession, data: str, shapes: str, data_format: str = "ttl", shapes_format: str = "ttl", mode: Mode = STRICT) -> bool:
    return validate_triples(read_graph(spark, data, data_format), read_triples(shapes, shapes_format), mode).conforms


def lint_data_graph(text: str, fmt: str = "ttl") -> str | None:
    """None for a text in the grammar, else what is wrong."""
    try:
        quads_of(text, fmt, BASE)
    except ParseError as e:
        return str(e)
    return None


def lint_shapes_graph(text: str, fmt: str = "ttl") -> str | None:
    """As for data, and whether its shapes can be read."""
    try:
        parse_shapes(read_triples(text, fmt))
    except (ParseError, ShapeError) as e:
        return str(e)
    return None


lint_graph = lint_data_graph


def parse_shapes_graph(text: str, fmt: str = "ttl", mode: Mode = STRICT) -> list[Shape]:
    return parse_shapes(read_triples(text, fmt), mode)
