"""Groups to DataFrames. Solutions have a column ``v_name`` a variable, and other columns that are passed through.

A group is evaluated on solutions that are there already, so pre-bound variables hold in every inner group. Groups of
OPTIONAL, EXISTS and MINUS are evaluated once, from the pre-bound variables that they mention, and joined to the
solutions; their filters are part of the join's condition. Variables that may be unbound are known as such: only they
cost a condition that is no plain equality.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count, takewhile
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import SHAPES_GRAPH, Dataset, Graph, local_frame
from ..operators import paths
from ..plans.ir import Alternative, Closure, Inverse, Path, Predicate, Sequence
from ..terms import Term, iri, is_term, make, same
from .ast import Bind, Call, Filter, Group, InGraph, Lateral, Minus, Optional, Query, Service, SubSelect, Triple, Union, Values, Var, walk
from .functions import TERM_TYPE, Expressions, aggregate, boolean, number, text
from .parser import AGGREGATES, QueryError

log = logging.getLogger(__name__)


def col(name: str) -> str:
    return f"v_{name}"


@dataclass(frozen=True)
class Rows:
    """Solutions; ``maybe`` names the variables that may be unbound."""

    frame: DataFrame
    maybe: frozenset[str] = frozenset()

    @property
    def names(self) -> list[str]:
        return [c[2:] for c in self.frame.columns if c.startswith("v_")]

    def where(self, test: Column) -> Rows:
        return replace(self, frame=self.frame.where(test))


def variables(parts: Iterable) -> set[str]:
    """The variables that the parts mention, in inner groups and expressions, too."""
    out: set[str] = set()
    for part in parts:
        for p in walk(part):
            if isinstance(p, Var):
                out.add(p.name)
            elif isinstance(p, Triple):
                out |= {x.name for x in (p.s, p.p, p.o) if isinstance(x, Var)}
            elif isinstance(p, Values):
                out |= set(p.names)
            elif isinstance(p, Bind):
                out.add(p.name)
            elif isinstance(p, InGraph) and isinstance(p.name, Var):
                out.add(p.name.name)
            elif isinstance(p, SubSelect):
                out |= {n for n, _ in p.query.select or ()}
    return out


def has_exists(e) -> bool:
    return isinstance(e, Call) and (e.name in ("exists", "not exists") or any(has_exists(a) for a in e.args))


class Evaluator:
    """``start`` are the pre-bound solutions, ``constants`` those of their variables that are the same in all of them."""

    def __init__(self, dataset: Dataset, start: DataFrame | None = None, constants: dict[str, Term] | None = None) -> None:
        self.dataset, self.spark = dataset, dataset.data.spark
        self.one = self.spark.range(1).select(F.lit(1).alias("_one"))
        self.start, self.constants = self.one if start is None else start, constants or {}
        self._number = count()

    def seed(self, mentioned: set[str]) -> Rows:
        """What an inner group starts from: the pre-bound variables that it mentions, or a single row."""
        names = [c for c in self.start.columns if c.startswith("v_") and c[2:] in mentioned]
        varied = [c for c in names if c[2:] not in self.constants]
        frame = self.start.select(*varied).distinct() if varied else self.one
        return Rows(frame.withColumns({c: self.constants[c[2:]].column() for c in names if c not in varied}))

    def expressions(self, rows: DataFrame) -> Expressions:
        names = set(rows.columns)
        return Expressions(lambda v: F.col(col(v)) if col(v) in names else boolean(F.col(v)) if v in names else None)

    # groups -----------------------------------------------------------------------------------------------------

    def group(self, g: Group, rows: Rows, graph: Graph) -> Rows:
        """Solutions of ``g`` that extend ``rows``; filters apply to the whole group."""
        filters = [p for p in g.parts if isinstance(p, Filter)]
        parts = self._ordered([p for p in g.parts if not isinstance(p, Filter)], rows)
        while parts:
            p = parts.pop(0)
            if isinstance(p, Triple):
                of_one = self._of_one(p, parts)
                if of_one and (found := self.star([p, *of_one], rows, graph)) is not None:
                    rows, parts = found, [x for x in parts if not any(x is y for y in of_one)]
                else:
                    rows = self.triple(p, rows, graph)
            elif isinstance(p, Group):
                rows = self.group(p, rows, graph)
            elif isinstance(p, Optional):
                rows = self.related(p.group, rows, graph, "left")
            elif isinstance(p, Union):
                rows = self.union([self.group(x, rows, graph) for x in p.groups])
            elif isinstance(p, Bind):
                if col(p.name) in rows.frame.columns:
                    raise QueryError(f"?{p.name} is bound already")
                value = self.expressions(rows.frame).term(p.value)
                unsure = frozenset() if isinstance(p.value, Term) else frozenset([p.name])
                rows = Rows(rows.frame.withColumn(col(p.name), value), rows.maybe | unsure)
            elif isinstance(p, Values):
                rows = self.values(p, rows)
            elif isinstance(p, InGraph):
                rows = self.in_graph(p, rows)
            elif isinstance(p, SubSelect):
                inner = self.select(p.query, self.seed(variables([p])), graph)
                rows = self.natural(rows, Rows(inner.frame.select(*map(col, inner.names)), inner.maybe))
            elif isinstance(p, Lateral):
                rows = self.lateral(p.group, rows, graph)
            elif isinstance(p, Minus):
                rows = self.related(p.group, rows, graph, "minus")
            elif isinstance(p, Service):
                raise QueryError("Service is not supported")
            else:
                raise QueryError(f"unknown pattern {p}")
        for f in filters:
            rows = self.filter(f.test, rows, graph)
        return rows

    @staticmethod
    def _ordered(parts: list, rows: Rows) -> list:
        """Runs of triples reordered so that each shares a variable with what is bound, if any does."""
        out, bound = [], set(rows.names)
        parts = list(parts)
        while parts:
            k = 0
            if isinstance(parts[0], Triple):
                run = next((i for i, p in enumerate(parts) if not isinstance(p, Triple)), len(parts))
                named = lambda t: {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
                k = next((i for i in range(run) if named(parts[i]) & bound or not named(parts[i])), 0)
                bound |= named(parts[k])
            out.append(parts.pop(k))
        return out

    @staticmethod
    def union(found: list[Rows]) -> Rows:
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.frame for r in found])
        missing = {n for r in found for n in set().union(*(x.names for x in found)) - set(r.names)}
        return Rows(frame, frozenset(missing).union(*(r.maybe for r in found)))

    def filter(self, e, rows: Rows, graph: Graph) -> Rows:
        if isinstance(e, Call) and e.name in ("exists", "not exists"):
            return self.related(e.args[0], rows, graph, "left_semi" if e.name == "exists" else "left_anti")
        if isinstance(e, Call) and e.name == "&&":
            return self.filter(e.args[1], self.filter(e.args[0], rows, graph), graph)
        if isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Call) and e.args[0].name in ("exists", "not exists"):
            inner = e.args[0]
            return self.filter(Call("not exists" if inner.name == "exists" else "exists", inner.args), rows, graph)
        before = rows.frame.columns
        if has_exists(e):
            rows, e = self._flagged(e, rows, graph)
        kept = rows.frame.where(F.coalesce(self.expressions(rows.frame).test(e), F.lit(False)))
        return Rows(kept.select(*before), rows.maybe)

    def _flagged(self, e, rows: Rows, graph: Graph) -> tuple[Rows, object]:
        """``e`` with each EXISTS inside it replaced by the name of a column that tells."""
        if not has_exists(e):
            return rows, e
        if e.name in ("exists", "not exists"):
            flag = f"_flag{next(self._number)}"
            found, key = self._hits(e.args[0], rows, graph)
            found = found.withColumn(flag, F.lit(e.name == "exists"))
            joined = self._on_keys(rows.frame, found, "left", key).withColumn(flag, F.coalesce(flag, F.lit(e.name != "exists")))
            return Rows(joined.select(*rows.frame.columns, flag), rows.maybe), Var(flag)
        args = []
        for a in e.args:
            rows, a = self._flagged(a, rows, graph)
            args.append(a)
        return rows, replace(e, args=tuple(args))

    # inner groups -------------------------------------------------------------------------------------------------

    def related(self, g: Group, rows: Rows, graph: Graph, how: str) -> Rows:
        """``rows`` joined to the solutions of an inner group: ``left``, ``left_semi``, ``left_anti`` or ``minus``.

        The group's filters see the solutions' variables, too, but for ``minus``.
        """
        filters = [p.test for p in g.parts if isinstance(p, Filter)]
        if how != "minus" and any(map(has_exists, filters)):
            return self._by_keys(g, rows, graph, how)
        rest = [p for p in g.parts if not isinstance(p, Filter)]
        if how == "minus":
            rest, filters = [g], []
        if how != "minus" and any(isinstance(p, Triple) and isinstance(p.p, Path) and _closes(p.p) for x in rest for p in walk(x)):
            # closures begin at what is bound, not at every node
            return self._by_keys(g, rows, graph, how)
        more = self.group(Group(tuple(rest)), self.seed(variables(rest)), graph)
        return self.joined(rows, more, how, filters)

    def _keyed(self, frame: DataFrame) -> tuple[DataFrame, str]:
        """The distinct rows with all columns a second time, and the prefix of these columns' names."""
        key = f"k{next(self._number)}_"
        return frame.distinct().select("*", *(F.col(c).alias(key + c) for c in frame.columns)), key

    def _hits(self, g: Group, rows: Rows, graph: Graph) -> tuple[DataFrame, str]:
        """The keys of ``rows`` for which ``g`` has a solution that extends them."""
        keyed, key = self._keyed(rows.frame)
        found = self.group(g, Rows(keyed, rows.maybe), graph).frame
        return found.select(*(key + c for c in rows.frame.columns)).distinct(), key

    @staticmethod
    def _on_keys(frame: DataFrame, found: DataFrame, how: str, key: str) -> DataFrame:
        return frame.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(key + c)) for c in frame.columns]), how)

    def _by_keys(self, g: Group, rows: Rows, graph: Graph, how: str) -> Rows:
        """As ``related``, with the group evaluated on the distinct solutions, which it is matched to again."""
        if how != "left":
            found, key = self._hits(g, rows, graph)
            return replace(rows, frame=self._on_keys(rows.frame, found, how, key))
        names = rows.frame.columns
        keyed, key = self._keyed(rows.frame)
        more = self.group(g, Rows(keyed, rows.maybe), graph)
        new = [c for c in more.frame.columns if c.startswith("v_") and c not in names]
        again = [c for c in names if c.startswith("v_") and c[2:] in rows.maybe]
        found = more.frame.select(*(key + c for c in names), *new, *(F.col(c).alias(f"n{key}{c}") for c in again))
        out = self._on_keys(rows.frame, found, "left", key)
        kept = [F.coalesce(F.col(f"n{key}{c}"), F.col(c)).alias(c) if c in again else F.col(c) for c in names]
        return Rows(out.select(*kept, *new), rows.maybe | {c[2:] for c in new})

    def lateral(self, g: Group, rows: Rows, graph: Graph) -> Rows:
        """Solutions of ``g`` for each solution by itself: a nested SELECT orders, limits and aggregates for each."""
        if len(g.parts) != 1 or not isinstance(g.parts[0], SubSelect):
            return self.group(g, rows, graph)
        names = rows.frame.columns
        keyed, key = self._keyed(rows.frame)
        inner = self.select(g.parts[0].query, Rows(keyed, rows.maybe), graph)
        new = [c for c in inner.frame.columns if c.startswith("v_") and c not in names]
        found = inner.frame.select(*(key + c for c in names), *new)
        return Rows(self._on_keys(rows.frame, found, "inner", key).select(*names, *new), rows.maybe | (inner.maybe & {c[2:] for c in new}))

    def joined(self, rows: Rows, more: Rows, how: str, filters: Iterable = ()) -> Rows:
        """``rows`` joined to ``more`` where the variables of both are compatible and the filters hold.

        ``how`` is ``inner``, ``left``, ``left_semi``, ``left_anti``, or ``minus``: the rows without a compatible one that
        shares a variable bound in both. Where all shared variables may be unbound in ``rows``, rows with and without one
        of them are joined apart, so that an equi-join does most of the work.
        """
        shared = [v for v in rows.names if v in more.names]
        if how == "minus":
            if not shared:
                return rows
        sure = [v for v in shared if v not in rows.maybe and v not in more.maybe]
        unsure = [v for v in shared if v in rows.maybe]
        if shared and not sure and unsure and how != "minus":
            v, rest = unsure[0], rows.maybe - {unsure[0]}
            with_ = self.joined(Rows(rows.frame.where(F.col(col(v)).isNotNull()), rest), more, how, filters)
            bare = Rows(rows.frame.where(F.col(col(v)).isNull()), rest)
            if how in ("left", "inner"):
                bare = self.joined(replace(bare, frame=bare.frame.drop(col(v))), more, how, filters)
                return self.union([with_, bare])
            # what the rows keep is unbound, whatever it is joined to
            kept = self.joined(replace(bare, frame=bare.frame.drop(col(v))), more, how, filters)
            nothing = F.lit(None).cast(TERM_TYPE).alias(col(v))
            return Rows(with_.frame.unionByName(kept.frame.select("*", nothing)), rows.maybe)
        if not shared and rows.names and more.names and how in ("inner", "left"):
            log.warning("patterns without a shared variable: every solution of one meets every one of the other")
        e = more.frame.select(*(F.col(col(v)).alias(f"_e_{v}" if v in shared else col(v)) for v in more.names))
        a, b = (lambda v: F.col(col(v))), (lambda v: F.col(f"_e_{v}"))

        def compatible(v: str) -> Column:
            both = same(a(v), b(v))
            for x, s in ((a(v), rows), (b(v), more)):
                if v in s.maybe:
                    both = x.isNull() | both
            return both

        tests = [compatible(v) for v in shared]
        if how == "minus":
            tests.append(reduce(or_, [a(v).isNotNull() & b(v).isNotNull() for v in shared]))
        either = lambda v: F.coalesce(a(v), b(v)) if v in rows.maybe else a(v)
        known = set(rows.names) | set(more.names)
        x = Expressions(lambda v: either(v) if v in shared else a(v) if v in known else None)
        tests += [F.coalesce(x.test(f), F.lit(False)) for f in filters]
        on = reduce(and_, tests) if tests else F.lit(True)
        out = rows.frame.join(e, on, "left_anti" if how == "minus" else how)
        if how not in ("inner", "left"):
            return replace(rows, frame=out)
        fresh = [v for v in more.names if v not in shared]
        picked = [either(c[2:]).alias(c) if c.startswith("v_") and c[2:] in shared else F.col(c) for c in rows.frame.columns]
        out = out.select(*picked, *(F.col(col(v)) for v in fresh))
        if how == "left":
            return Rows(out, rows.maybe | set(fresh))
        both = {v for v in shared if v in rows.maybe and v in more.maybe}
        return Rows(out, frozenset((rows.maybe - set(shared)) | both | (more.maybe & set(fresh))))

    def natural(self, rows: Rows, more: Rows) -> Rows:
        return self.joined(rows, more, "inner")

    @staticmethod
    def matching(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """Rows with or without an equal row, by all columns of ``rows``, unbound ones included."""
        names = rows.columns
        o = other.select(*(F.col(c).alias(f"_o_{c}") for c in names)).distinct()
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in names])
        return rows.join(o, on, how)

    # patterns ---------------------------------------------------------------------------------------------------

    @staticmethod
    def _of_one(t: Triple, parts: list) -> list[Triple]:
        """The triples next to ``t`` with its subject, if that is a variable and all predicates are plain or variables."""
        if not isinstance(t.s, Var) or not isinstance(t.p, Var | Predicate):
            return []
        run = takewhile(lambda x: isinstance(x, Triple), parts)
        return [x for x in run if x.s == t.s and isinstance(x.p, Var | Predicate)]

    def star(self, some: list[Triple], rows: Rows, graph: Graph) -> Rows | None:
        """Solutions of triples with one subject by one pass over the rows of a table that alone has such nodes, if one does."""
        edges = graph.star([None if isinstance(t.p, Var) else t.p.iri for t in some])
        if edges is None:
            return None
        ends = {"s": some[0].s}
        for i, t in enumerate(some):
            if isinstance(t.p, Var):
                ends[f"p{i}"], edges = t.p, edges.withColumn(f"p{i}", make("iri", F.col(f"p{i}")))
            ends[f"o{i}"] = t.o
        return self.edges(rows, edges, ends)

    def triple(self, t: Triple, rows: Rows, graph: Graph) -> Rows:
        if isinstance(t.p, Var):
            edges = graph.triples().select("s", make("iri", F.col("p")).alias("p"), "o")
            return self.edges(rows, edges, {"s": t.s, "p": t.p, "o": t.o})
        # sequences, alternatives and inverses are joins, unions and swaps, which keep repeated solutions; closures have none
        if isinstance(t.p, Inverse):
            return self.triple(Triple(t.o, t.p.path, t.s), rows, graph)
        if isinstance(t.p, Sequence):
            between = [Var(f"_q{next(self._number)}") for _ in t.p.parts[1:]]
            ends = [t.s, *between, t.o]
            steps = [Triple(a, p, b) for a, p, b in zip(ends, t.p.parts, ends[1:], strict=False)]
            out = self.group(Group(tuple(steps)), rows, graph)
            return Rows(out.frame.drop(*(col(v.name) for v in between)), out.maybe)
        if isinstance(t.p, Alternative):
            return self.union([self.triple(Triple(t.s, p, t.o), rows, graph) for p in t.p.parts])
        edges = paths.pairs(t.p, graph)
        if edges is None:
            edges = self.closure(t, rows, graph)
        return self.edges(rows, edges, {"s": t.s, "o": t.o})

    def closure(self, t: Triple, rows: Rows, graph: Graph) -> DataFrame:
        """(s, o) of a path with ``*``, ``+`` or ``?``: from an end that is bound or, if neither is, from every node."""
        bound = lambda x: isinstance(x, Term) or (x.name in rows.names and x.name not in rows.maybe)
        back = not bound(t.s) and bound(t.o)
        start, path = (t.o, paths.inverted(t.p)) if back else (t.s, t.p)
        if isinstance(start, Term):
            starts = local_frame(self.spark, [(start,)], focus="term")
        elif bound(start):
            starts = rows.frame.select(F.col(col(start.name)).alias("focus")).distinct()
        else:
            starts = graph.triples().select(F.explode(F.array("s", "o")).alias("focus")).distinct()
        found = paths.follow(starts.withColumn("value", F.col("focus")), path, graph)
        s, o = ("value", "focus") if back else ("focus", "value")
        return found.select(F.col(s).alias("s"), F.col(o).alias("o"))

    def edges(self, rows: Rows, edges: DataFrame, ends: dict) -> Rows:
        """Natural join of solutions with the columns of ``edges`` that variables name."""
        fresh: dict[str, str] = {}
        for c, x in ends.items():
            if isinstance(x, Term):
                edges = edges.where(is_term(F.col(c), x))
            elif x.name in fresh:
                edges = edges.where(same(F.col(c), F.col(fresh[x.name])))
            else:
                fresh[x.name] = c
        if not fresh:
            return replace(rows, frame=rows.frame.crossJoin(edges.select(F.lit(1).alias("_hit")).limit(1)).drop("_hit"))
        return self.natural(rows, Rows(edges.select(*(F.col(c).alias(col(v)) for v, c in fresh.items()))))

    def values(self, p: Values, rows: Rows) -> Rows:
        data = local_frame(self.spark, p.rows, **{col(v): "term" for v in p.names})
        unsure = frozenset(v for i, v in enumerate(p.names) if any(r[i] is None for r in p.rows))
        return self.natural(rows, Rows(F.broadcast(data), unsure))  # as long as the query's text

    def in_graph(self, p: InGraph, rows: Rows) -> Rows:
        if isinstance(p.name, Term):
            g = self.dataset.named(p.name.lex)
            return rows.where(F.lit(False)) if g is None else self.group(p.group, rows, g)
        g, name = self.dataset.named(SHAPES_GRAPH), iri(SHAPES_GRAPH)
        rows = self.natural(rows, Rows(local_frame(self.spark, [(name,)], **{col(p.name.name): "term"})))
        return self.group(p.group, rows, g)

    # queries ----------------------------------------------------------------------------------------------------

    def select(self, q: Query, rows: Rows, graph: Graph | None = None) -> Rows:
        """Solutions of a SELECT that extend ``rows``, whose columns are kept. Each row is a run of its own: aggregates,
        DISTINCT, ORDER BY, LIMIT and OFFSET hold for its solutions."""
        base = rows.frame.columns
        found = self.group(q.where, rows, graph or self.dataset.data)
        columns = [(v, Var(v)) for v in found.names] if q.star else list(q.select)
        out = found.frame
        if q.group_by or q.having or any(_has_aggregate(e) for _, e in columns):
            out = self._grouped(q, columns, out, rows.frame)
            columns = [(n, Var(n)) for n, _ in columns]
        x = self.expressions(out)
        own = base == ["_one"]
        order = []
        for i, (e, down) in enumerate(q.order_by if own or q.limit is not None or q.offset else ()):
            t = x.term(e)
            out = out.withColumn(f"_by{i}", F.struct(t.isNotNull(), F.coalesce(t["num"], F.lit(0.0)), t["lex"]))
            order.append(F.col(f"_by{i}").desc() if down else F.col(f"_by{i}").asc())
        picked = [F.col(c) for c in base if c not in {col(n) for n, _ in columns}]
        keys = [c for c in out.columns if c.startswith("_by")]
        shown = [x.term(e).alias(col(n)) for n, e in columns]
        out = out.select(*picked, *shown, *keys)
        names = [c for c in out.columns if c not in keys]
        if q.distinct and keys:
            out = out.groupBy(*names).agg(*(F.min(c).alias(c) for c in keys))
        elif q.distinct:
            out = out.distinct()
        if own:
            if order:
                out = out.orderBy(*order)
            if q.offset:
                out = out.offset(q.offset)
            if q.limit is not None:
                out = out.limit(q.limit)
        elif q.limit is not None or q.offset:
            by = Window.partitionBy(*(c for c in base if c in out.columns)).orderBy(*order, *(F.col(c) for c in names if c not in base))
            out = out.withColumn("_row", F.row_number().over(by))
            if q.limit is not None:
                out = out.where(F.col("_row") <= q.offset + q.limit)
            out = out.where(F.col("_row") > q.offset)
        plain = {n for n, e in columns if isinstance(e, Var) and e.name == n}
        unsure = frozenset(n for n, _ in columns if n not in plain or n in found.maybe or col(n) not in found.frame.columns)
        kept = frozenset(c[2:] for c in base if c.startswith("v_")) & rows.maybe
        return Rows(out.select(*names), unsure | kept)

    def _grouped(self, q: Query, columns: list, out: DataFrame, base: DataFrame) -> DataFrame:
        """A row a group. Without GROUP BY the solutions of each base row are a group, even if there are none."""
        x = self.expressions(out)
        keys = [F.col(c) for c in base.columns]
        names = set(base.columns)
        for n, e in q.group_by:
            if col(n) not in names:
                keys.append(x.term(e).alias(col(n)))
                names.add(col(n))
        calls: dict[Call, str] = {}
        made = []
        for n, e in columns:
            if _has_aggregate(e):
                made.append((n, self._hoisted(e, calls)))
            elif col(n) not in names:
                raise QueryError(f"?{n} is neither grouped by nor an aggregate")
        having = [self._hoisted(e, calls) for e in q.having]
        aggregates = [aggregate(c, x).alias(col(n)) for c, n in calls.items()]
        grouped = out.groupBy(*keys).agg(*aggregates) if aggregates else out.select(*keys).distinct()
        if not q.group_by and aggregates:
            key = f"k{next(self._number)}_"
            grouped = grouped.select(*(F.col(c).alias(key + c) for c in base.columns), *(col(n) for n in calls.values()))
            whole = self._on_keys(base.distinct(), grouped, "left", key)
            empty = {"count": number(F.lit(0.0)), "sum": number(F.lit(0.0)), "avg": number(F.lit(0.0)), "group_concat": text(F.lit(""))}
            value = lambda c, n: F.coalesce(F.col(col(n)), empty[c.name]) if c.name in empty else F.col(col(n))
            # an aggregate over solutions that raises an error is unbound; only those over none have a value by themselves
            none = F.col(key + base.columns[0]).isNull()
            grouped = whole.select(
                *base.columns, *(F.when(none, value(c, n)).otherwise(F.col(col(n))).alias(col(n)) for c, n in calls.items())
            )
        for n, e in made:
            grouped = grouped.withColumn(col(n), self.expressions(grouped).term(e))
        for e in having:
            grouped = grouped.where(F.coalesce(self.expressions(grouped).test(e), F.lit(False)))
        return grouped

    def _hoisted(self, e, calls: dict[Call, str]):
        """The expression with its aggregates replaced by variables, which ``calls`` names."""
        if isinstance(e, Call) and e.name in AGGREGATES:
            return Var(calls.setdefault(e, f"_a{len(calls)}"))
        if isinstance(e, Call):
            return replace(e, args=tuple(self._hoisted(a, calls) for a in e.args))
        return e


def _has_aggregate(e) -> bool:
    return isinstance(e, Call) and (e.name in AGGREGATES or any(_has_aggregate(a) for a in e.args))


def _closes(path: Path) -> bool:
    return isinstance(path, Closure) or any(_closes(p) for p in (*getattr(path, "parts", ()), *([path.path] if hasattr(path, "path") else [])))


def constructed(template: Iterable[Triple], rows: Rows) -> DataFrame:
    """(s, p, o): the distinct triples that a template makes of solutions; a blank node is one a solution."""
    columns = rows.frame.columns
    solution = F.hex(F.xxhash64(*columns)) if columns else F.lit("")

    def node(x) -> Column:
        if isinstance(x, Term):
            return x.column()
        if col(x.name) in columns:
            return F.col(col(x.name))
        if x.name.startswith("_"):
            return make("bnode", F.concat(F.lit(x.name.lstrip("_")), solution))
        return F.lit(None).cast(TERM_TYPE)

    made = []
    for t in template:
        p = t.p if isinstance(t.p, Var) else iri(t.p.iri)
        made.append(F.struct(node(t.s).alias("s"), node(p).alias("p"), node(t.o).alias("o")))
    out = rows.frame.select(F.explode(F.array(*made)).alias("t")).select("t.*")
    out = out.where("s is not null and p.kind = 'iri' and o is not null and s.kind <> 'literal'")
    return out.select("s", F.col("p.lex").alias("p"), "o").distinct()


def run_query(dataset: Dataset, query: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The solutions of a SELECT (a term column a variable), a row (ask) of an ASK, or the triples (s, p, o) of a CONSTRUCT
    or DESCRIBE, which gives the triples with a described node as their subject."""
    from .parser import parse_query

    q, ev = parse_query(query, prefixes), Evaluator(dataset)
    start = Rows(ev.one)
    if q.construct is not None:
        return constructed(q.construct, replace(found := ev.select(q, start), frame=found.frame.drop("_one")))
    if q.describe is not None:
        frames = [local_frame(ev.spark, [(x,)], node="term") for x in q.describe if isinstance(x, Term)]
        if names := [x.name for x in q.describe if isinstance(x, Var)]:
            found = ev.select(q, start).frame
            frames += [found.select(F.col(col(n)).alias("node")) for n in names if col(n) in found.columns]
        nodes = reduce(DataFrame.unionByName, frames).where("node is not null").distinct()
        return dataset.data.triples().join(nodes, same(F.col("s"), F.col("node")), "left_semi").select("s", "p", "o")
    if q.select is None:
        found = ev.group(q.where, start, dataset.data).frame
        return found.agg((F.count("*") > 0).alias("ask"))
    out = ev.select(q, start).frame.drop("_one")
    return out.withColumnsRenamed({c: c[2:] for c in out.columns})
