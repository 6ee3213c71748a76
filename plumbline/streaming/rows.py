"""Shapes over streaming tables.

Constraints that look at one value need no state: they run on a streaming DataFrame as they do on a batch. Others
depend on all triples of a focus node; for these a stream is validated batch by batch, each batch as its own graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import validate
from ..graph import Dataset, MappedGraph, Mapping
from ..plans.compile import LOCAL, Compiler
from ..plans.ir import Predicate, Shape
from ..plans.mode import STRICT, Mode
from ..report import rendered


def stateless(shape: Shape) -> bool:
    """Whether a shape only tests single values of direct predicates of its own focus."""
    if any(c.name not in LOCAL for c in shape.constraints):
        return False
    return all(isinstance(p.path, Predicate) and not p.properties and stateless(p) for p in shape.properties)


def validate_stream(mapping: Mapping, shapes: list[Shape], mode: Mode = STRICT) -> DataFrame:
    """Streaming results of stateless shapes over a streaming table; every row of the table is a focus node.

    A column's value is read from the row itself, so there is no join and no state.
    """
    graph = MappedGraph([mapping])
    compiler = Compiler(Dataset(graph), mode)
    found = []
    subject = mapping.subject.term()
    for s in shapes:
        if not stateless(s):
            raise ValueError(f"shape {s.node} needs more than one value at a time")
        for p in (s, *s.properties):
            local = list(p.constraints)
            if not local or p.deactivated:
                continue
            if p.path is None:
                value = subject
            elif p.path.iri in mapping.predicates:
                value = mapping.predicates[p.path.iri].term()
            else:
                continue
            vals = mapping.frame.select(subject.alias("root"), subject.alias("focus"), value.alias("value")).where("value.lex is not null")
            found.append(compiler._finish(p, compiler._local(local, vals)))
    if not found:
        raise ValueError("no constraint to test")
    return rendered(reduce(DataFrame.unionByName, found))


def each_batch(mapping: Callable[[DataFrame], Mapping], shapes: list[Shape], sink: Callable[[DataFrame, int], None], mode: Mode = STRICT):
    """A function for ``writeStream.foreachBatch`` that validates each batch and hands its results to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        report = validate(MappedGraph([mapping(batch)]), shapes, mode)
        sink(report.results.withColumn("batch", F.lit(number)), number)

    return run
