"""Property paths: (keys..., focus) to (keys..., focus, value), set at a time.

Each step joins the current values with a predicate's pairs and makes them distinct; closures are loops over the distinct
start nodes, so foci that share a node share its closure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.ir import Alternative, Closure, Inverse, Negated, Path, Predicate, Sequence
from ..terms import same, text_of
from .fixpoint import cut


def node_key(t: Column) -> Column:
    """A text that tells nodes apart: an IRI or ``_:`` and a blank node's label. Literals are no subjects."""
    return F.when(t["kind"] == "iri", t["lex"]).when(t["kind"] == "bnode", F.concat(F.lit("_:"), t["lex"]))


def pairs(path: Path, graph: Graph) -> DataFrame | None:
    """(s, o) of the path over the whole graph, distinct; None if it has pairs for every node (``*`` and ``?``)."""
    if isinstance(path, Predicate):
        return graph.pred(path.iri)
    if isinstance(path, Inverse):
        inner = pairs(path.path, graph)
        return None if inner is None else inner.select(F.col("o").alias("s"), F.col("s").alias("o"))
    if isinstance(path, Negated):
        t = graph.triples()
        found = []
        if path.forward or not path.backward:
            found.append(t.where(~F.col("p").isin(list(path.forward))).select("s", "o"))
        if path.backward:
            found.append(t.where(~F.col("p").isin(list(path.backward))).select(F.col("o").alias("s"), F.col("s").alias("o")))
        return reduce(DataFrame.unionByName, found).distinct()
    if isinstance(path, Alternative):
        parts = [pairs(p, graph) for p in path.parts]
        return None if None in parts else reduce(DataFrame.unionByName, parts).distinct()
    if isinstance(path, Sequence):
        out = pairs(path.parts[0], graph)
        if out is None:
            return None
        rest = path.parts[1] if len(path.parts) == 2 else Sequence(path.parts[1:])
        return follow(out.select(F.col("s").alias("focus"), F.col("o").alias("value")), rest, graph).select(
            F.col("focus").alias("s"), F.col("value").alias("o")
        )
    return None


def step(now: DataFrame, edges: DataFrame) -> DataFrame:
    """Values one edge further, distinct with all other columns; literals have no edges."""
    keys = [c for c in now.columns if c != "value"]
    e = edges.select(node_key(F.col("s")).alias("_s"), F.col("o").alias("_o"))
    n = now.withColumn("_k", node_key(F.col("value")))
    return n.join(e, F.col("_k") == F.col("_s")).select(*keys, F.col("_o").alias("value"))


def _onto(now: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``step``, from values that may be literals, since they are objects of the edges' triples."""
    e = edges.select(F.col("s").alias("_s"), F.col("o").alias("_o"))
    keys = [c for c in now.columns if c != "value"]
    return now.join(e, same(F.col("value"), F.col("_s"))).select(*keys, F.col("_o").alias("value"))


def _key(t: Column) -> Column:
    """A text that tells terms apart: that of ``node_key``, and a literal as N-Triples writes it."""
    return F.coalesce(node_key(t), text_of(t))


def closure(starts: DataFrame, path: Path, graph: Graph, with_start_on_cycle: bool) -> DataFrame:
    """(start, value): nodes one or more steps away from each distinct ``start``. With ``with_start_on_cycle`` off, the start
    itself never counts as reached.

    The loop works on texts of nodes; terms are joined again at its end. From many starts the steps are doubled: what
    is reached in 2^k steps, joined with the pairs exactly 2^k steps apart, so rounds grow with the logarithm of the
    longest way. From few starts it is semi-naive: only pairs found in the last round go on.
    """
    found = pairs(path, graph)
    if found is None:
        return _closure_of_closure(starts, path, graph, with_start_on_cycle)
    edges = cut(found.select(node_key(F.col("s")).alias("s"), _key(F.col("o")).alias("o"), F.col("o").alias("term")))
    starts = cut(starts.select("start", node_key(F.col("start")).alias("a")))
    steps = edges.select("s", "o").distinct()
    begun = starts.select("a").join(steps, F.col("a") == F.col("s")).select("a", F.col("o").alias("b"))
    reached = _doubled(begun, steps) if STARTS * starts.count() >= edges.count() else _semi_naive(begun, steps)
    values = edges.select("o", "term").groupBy("o").agg(F.first("term").alias("value"))
    out = reached.join(starts, "a").join(values, F.col("b") == F.col("o")).select("start", "value")
    return out if with_start_on_cycle else out.where(~same(F.col("start"), F.col("value")))


#: Steps are doubled if starts are more than one in so many of the edges.
STARTS = 4


def _doubled(begun: DataFrame, steps: DataFrame) -> DataFrame:
    now, exact = cut(begun), cut(steps)
    n = now.count()
    while True:
        further = now.join(exact, F.col("b") == F.col("s")).select("a", F.col("o").alias("b"))
        now = cut(now.unionByName(further).distinct())
        before, n = n, now.count()
        if n == before:
            return now
        x, y = exact.alias("x"), exact.alias("y")
        exact = cut(x.join(y, F.col("x.o") == F.col("y.s")).select("x.s", "y.o").distinct())


def _semi_naive(begun: DataFrame, steps: DataFrame) -> DataFrame:
    frontier, steps = cut(begun), cut(steps)
    seen = frontier.withColumn("fresh", F.lit(0))
    while not frontier.isEmpty():
        moved = frontier.join(steps, F.col("b") == F.col("s")).select("a", F.col("o").alias("b"), F.lit(1).alias("fresh"))
        # one exchange tells what is new and makes it distinct
        frontier = cut(seen.unionByName(moved).groupBy("a", "b").agg(F.min("fresh").alias("fresh")).where("fresh = 1").select("a", "b"))
        seen = seen.unionByName(frontier.withColumn("fresh", F.lit(0)))
    return seen.select("a", "b")


def _closure_of_closure(starts: DataFrame, path: Path, graph: Graph, with_start_on_cycle: bool) -> DataFrame:
    """As ``closure``, of a path that has pairs for every node and so no table of edges."""
    frontier = starts.select("start", F.col("start").alias("value"))
    seen = None
    while True:
        moved = follow(frontier.withColumnRenamed("start", "focus"), path, graph).withColumnRenamed("focus", "start")
        if not with_start_on_cycle:
            moved = moved.where(~same(F.col("start"), F.col("value")))
        if seen is not None:
            a, b = moved.alias("a"), seen.alias("b")
            known = same(F.col("a.start"), F.col("b.start")) & same(F.col("a.value"), F.col("b.value"))
            moved = a.join(b, known, "left_anti")
        frontier = cut(moved)
        if frontier.isEmpty():
            return seen if seen is not None else frontier
        seen = frontier if seen is None else seen.unionByName(frontier)


def follow(now: DataFrame, path: Path, graph: Graph, cycle_back: bool = True) -> DataFrame:
    """The values that ``path`` reaches from each row's ``value``; other columns are kept, and rows are distinct."""
    if isinstance(path, Sequence):
        parts = list(path.parts)
        while parts:
            p = parts.pop(0)
            if parts and isinstance(parts[0], Predicate) and isinstance(p, Inverse) and isinstance(p.path, Predicate):
                rows = graph.across(p.path.iri, parts[0].iri)
                if rows is not None:
                    parts.pop(0)
                    now = _onto(now, rows).distinct()
                    continue
            now = follow(now, p, graph, cycle_back)
        return now
    if isinstance(path, Alternative):
        return reduce(DataFrame.unionByName, [follow(now, p, graph, cycle_back) for p in path.parts]).distinct()
    if isinstance(path, Closure):
        if not path.many:
            return now.unionByName(follow(now, path.path, graph, cycle_back)).distinct()
        starts = now.select(F.col("value").alias("start")).where("start.kind <> 'literal'").distinct()
        reached = closure(starts, path.path, graph, cycle_back or path.least == 0)
        keys = [c for c in now.columns if c != "value"]
        r = reached.select(F.col("start").alias("_s"), F.col("value").alias("_v"))
        further = now.join(r, same(F.col("value"), F.col("_s"))).select(*keys, F.col("_v").alias("value"))
        return (now.unionByName(further) if path.least == 0 else further).distinct()
    if isinstance(path, Inverse) and not isinstance(path.path, Predicate):
        return follow(now, inverted(path.path), graph, cycle_back)
    edges = pairs(path, graph)
    if isinstance(path, Inverse):
        return _onto(now, edges).distinct()
    return step(now, edges).distinct()


def inverted(path: Path) -> Path:
    """The path walked backwards."""
    if isinstance(path, Inverse):
        return path.path
    if isinstance(path, Sequence):
        return Sequence(tuple(inverted(p) for p in reversed(path.parts)))
    if isinstance(path, Alternative):
        return Alternative(tuple(inverted(p) for p in path.parts))
    if isinstance(path, Closure):
        return Closure(inverted(path.path), path.least, path.many)
    if isinstance(path, Negated):
        return Negated(path.backward, path.forward)
    return Inverse(path)


def single(path: Path) -> bool:
    """Whether the path is one predicate, forwards or backwards, whose pairs are distinct as they are."""
    return isinstance(path, Predicate) or (isinstance(path, Inverse) and isinstance(path.path, Predicate))


def resolve(foci: DataFrame, path: Path, graph: Graph, cycle_back: bool = True) -> DataFrame:
    """(…, focus, value) for distinct rows of ``foci`` (…, focus)."""
    now = foci.withColumn("value", F.col("focus"))
    if isinstance(path, Predicate):
        return step(now, pairs(path, graph))  # foci and pairs are distinct, so are rows
    if single(path):
        e = pairs(path, graph).select(F.col("s").alias("_s"), F.col("o").alias("_o"))
        return now.join(e, same(F.col("value"), F.col("_s"))).select(*foci.columns, F.col("_o").alias("value"))
    return follow(now, path, graph, cycle_back)


def direct_predicates(path: Path | None, deep: bool) -> set[str]:
    """The predicate of a path of one predicate; with ``deep`` all predicates that it names."""
    if isinstance(path, Predicate):
        return {path.iri}
    if not deep or path is None:
        return set()
    inner = path.parts if isinstance(path, (Sequence, Alternative)) else [path.path] if isinstance(path, Closure) else []
    return set().union(*(direct_predicates(p, True) for p in inner), set())
