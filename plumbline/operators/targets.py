"""Targets: the focus nodes of a shape, as distinct rows (focus)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SUBCLASS, SUBPROPERTY, Graph, local_frame
from ..plans.ir import Target

def constants(graph: Graph, terms) -> DataFrame:
    """A constant set of nodes."""
    return local_frame(graph.spark, ((t,) for t in dict.fromkeys(terms)), focus="term")


def resolve_target(target: Target, graph: Graph, literals: bool = False) -> DataFrame:
    """(focus) of one target. Properties and classes count with those below them in the data graph.

    ``literals`` keeps literal objects of ``objects`` targets. An advanced target selects nothing.
    """
    kind, t = target.kind, target.term
    if kind == "node":
        return constants(graph, [t])
    if kind in ("class", "implicit"):
        return graph.instances(graph.below(t.lex, SUBCLASS)).select(F.col("s").alias("focus"))
    if kind in ("subjects", "objects"):
        pairs = graph.preds(graph.below(t.lex, SUBPROPERTY))
        if kind == "subjects":
            return pairs.select(F.col("s").alias("focus")).distinct()
        objects = pairs if literals else pairs.where("o.kind <> 'literal'")
        return objects.select(F.col("o").alias("focus")).distinct()
    if kind == "advanced":
        return constants(graph, [])
    raise ValueError(f"unknown kind of target: {kind}")


class Targets:
    """Resolves targets once each for all shapes of a run."""

    def __init__(self, graph: Graph, literals: bool = False) -> None:
        self.graph, self.literals = graph, literals
        self._known: dict[Target, DataFrame] = {}

    def of(self, targets: tuple[Target, ...]) -> DataFrame:
        found = []
        nodes = [t for t in targets if t.kind == "node"]
        if nodes:
            found.append(constants(self.graph, [t.term for t in nodes]))
        for t in targets:
            if t.kind != "node":
                if t not in self._known:
                    self._known[t] = resolve_target(t, self.graph, self.literals)
                found.append(self._known[t])
        if not found:
            return constants(self.graph, [])
        return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()
