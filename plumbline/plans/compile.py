"""Shapes to plans: every constraint of a shape is evaluated for all focus nodes at once.

``Compiler.results`` maps (root, focus) rows to result rows. ``root`` is the node that an enclosing shape asks about,
which nested property shapes carry along while they report foci of their own. Constraints that look at one value are
fused into a single pass over the values, those that count values of a focus into a single aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import count
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..graph import SUBCLASS, Dataset, Mapping, renamed
from ..operators import paths
from ..operators.fixpoint import cut
from ..operators.targets import Targets
from ..terms import TERM, in_terms, is_term, same
from .ir import Constraint, Inverse, Path, Predicate, Sequence, Shape
from .mode import STRICT, Mode

RESULT = (
    f"root {TERM}, focus {TERM}, path string, value {TERM}, component string, detail string, messages array<string>, "
    "shape string, name string, severity string, trace array<string>, source string"
)
NO_TERM = f"CAST(NULL AS {TERM})"

#: Components registered by users: IRI to fn(compiler, shape, constraint, foci, values, home) -> DataFrame.
COMPONENTS: dict[str, Callable] = {}


def register_component(iri: str, fn: Callable) -> None:
    """Add a constraint component; ``fn`` returns the violations: columns of ``values`` and a ``message``."""
    COMPONENTS[iri] = fn


class Compiler:
    """Compiles the shapes of one run over one dataset; equal nested questions share their plan."""

    def __init__(self, dataset: Dataset, mode: Mode = STRICT) -> None:
        self.dataset, self.graph, self.mode = dataset, dataset.data, mode
        self.spark = self.graph.spark
        self.targets = Targets(self.graph, mode.literal_objects)
        self._number, self._depth = count(), 0
        self._below: dict[tuple[str, str], list[str]] = {}
        #: (shape, component, result rows of an inner shape, whose roots are the values that were asked about, and a key if they
        #: are just those that explain a result or detail: that of distinct rows if no other has it, or an empty text)
        self.details: list[tuple[str, str, DataFrame, str | None]] | None = None

    # shapes ---------------------------------------------------------------------------------------------------

    def validate(self, shape: Shape) -> DataFrame:
        """Result rows of a shape for its targets."""
        if shape.deactivated or not shape.targets:
            return self.none()
        wide = all(t.kind in ("class", "implicit", "subjects") for t in shape.targets)
        return self.results(shape, self.targets.of(shape.targets), wide=wide, home=self._home(shape))

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], RESULT)

    def failing(self, shape: Shape, nodes: DataFrame, narrowed: bool = False, outer: tuple[Shape, Constraint] | None = None) -> DataFrame:
        """(value): the distinct nodes of ``nodes`` (value) that don't conform to ``shape``.

        ``narrowed`` tells that ``nodes`` is itself the outcome of other shapes. The results of ``shape`` are details of
        those of the shape and constraint ``outer``.
        """
        if shape.deactivated and self.mode.deactivated_everywhere:
            return nodes.where("false")
        self._depth += 1
        try:
            if self._depth > 1 or narrowed:
                # each constraint inside reads the nodes again; without a cut, plans would grow with the power of the depth
                nodes = cut(nodes)
            found = self.results(shape, nodes.select(F.col("value").alias("focus")))
            if self.details is not None and outer is not None:
                self.details.append((str(outer[0].node), outer[1].component, found, None))
            return found.select(F.col("root").alias("value")).distinct()
        finally:
            self._depth -= 1

    def _home(self, shape: Shape) -> Mapping | None:
        """The table whose rows are just the focus nodes of the shape's targets, if there is one."""
        if not all(t.kind in ("class", "implicit") for t in shape.targets):
            return None
        return self.graph.home([c for t in shape.targets for c in self.below(t.term.lex, SUBCLASS)])

    def values(self, path: Path | None, foci: DataFrame, home: Mapping | None = None) -> DataFrame:
        """``foci`` with ``value``: the focus itself without a path, else each of the path's distinct values.

        If the foci are the rows of a table, a predicate that is one of its columns needs no join.
        """
        if path is None:
            return foci.withColumn("value", F.col("focus"))
        if home is not None and "root" not in foci.columns and (rows := self.rows_with(home, path)) is not None:
            frame, (column,) = rows
            return frame.select(home.subject.term().alias("focus"), column.alias("value")).where("value.lex is not null")
        first, rest = (path.parts[0], path.parts[1:]) if isinstance(path, Sequence) else (path, ())
        column = self.graph.column_of(home, first.iri) if home is not None and isinstance(first, Predicate) else None
        if column is None:
            return paths.resolve(foci, path, self.graph, self.mode.cycle_back)
        now = home.frame.select(home.subject.term().alias("focus"), column.alias("value")).where("value.lex is not null")
        for p in rest:
            now = paths.follow(now, p, self.graph, self.mode.cycle_back)
        return now

    # rows of tables -----------------------------------------------------------------------------------------------

    def rows_with(self, home: Mapping, *some: Path) -> tuple[DataFrame, list[Column]] | None:
        """The rows of a table with a term column for the value of each path, null where there is none.

        None if a path is no chain of predicates that lead from a row to one row of the next table, by columns that
        equal. So a path is a join on those columns, whatever the IRIs look like, and needs no distinct.
        """
        frame, columns = home.frame, []
        for path in some:
            steps = path.parts if isinstance(path, Sequence) else (path,)
            if not all(isinstance(s, Predicate) for s in steps):
                return None
            now = home
            for s in steps[:-1]:
                to = self.graph.pointed(now, s.iri)
                if to is None:
                    return None
                to = renamed(to, f"_t{next(self._number)}_")
                frame = frame.join(to.frame, F.col(now.predicates[s.iri].column) == F.col(to.subject.column), "left")
                now = to
            column = self.graph.column_of(home, steps[0].iri) if now is home else self._own(now, steps[-1].iri)
            if column is None:
                return None
            columns.append(F.when(column["lex"].isNotNull(), column))
        return frame, columns

    def _own(self, to: Mapping, p: str) -> Column | None:
        """A predicate's column of a table that was renamed, if that table alone has it for its rows."""
        original = next(m for m in self.graph.mappings if m.subject.base == to.subject.base)
        return to.predicates[p].term() if self.graph.column_of(original, p) is not None else None

    def row_test(self, shape: Shape, table: Mapping, node: Column | None = None) -> Column | None:
        """Whether the row of a table, as the node ``node``, conforms to ``shape``; None if its columns alone don't tell."""
        node = table.subject.term() if node is None else node
        if shape.deactivated and self.mode.deactivated_everywhere:
            return F.lit(True)
        own = (lambda p: self._own(table, p)) if hasattr(self.graph, "mappings") else (lambda p: None)
        if shape.path is None:
            value, count_ = node, F.lit(1)
        else:
            value = own(shape.path.iri) if isinstance(shape.path, Predicate) and shape.path.iri in table.predicates else None
            if value is None or shape.properties:
                return None
            value = F.when(value["lex"].isNotNull(), value)
            count_ = value.isNotNull().cast("int")
        tests = []
        for c in shape.constraints:
            p = c.params
            if c.name in LOCAL:
                tests += [value.isNull() | ~F.coalesce(broken, F.lit(False)) for broken, _ in LOCAL[c.name](self, c, value)]
            elif c.name == "MinCount":
                tests.append(count_ >= p["minCount"])
            elif c.name == "MaxCount":
                tests.append(count_ <= p["maxCount"])
            elif c.name == "HasValue":
                tests.append(F.coalesce(is_term(value, p["hasValue"]), F.lit(False)))
            elif shape.path is None and c.name in LOGIC and (holds := self._logic(c, table, node)) is not None:
                tests.append(holds)
            else:
                return None
        for q in shape.properties:
            one = self.row_test(q, table, node)
            if one is None:
                return None
            tests.append(one)
        return reduce(and_, tests) if tests else F.lit(True)

    def _logic(self, c: Constraint, table: Mapping, node: Column | None = None) -> Column | None:
        """Whether a node that is a row of a table meets a logical constraint; None if the row alone doesn't tell."""
        inner = c.params[c.name.lower()]
        if not (self.mode.siblings_disjoint_only or c.name != "Node"):
            return None
        tests = [self.row_test(s, table, node) for s in (inner if isinstance(inner, (list, tuple)) else [inner])]
        return None if any(t is None for t in tests) else LOGIC[c.name](tests)

    def logical(self, shape: Shape, c: Constraint, vals: DataFrame, home: Mapping | None) -> DataFrame | None:
        """Violations of a logical constraint by one pass over the rows that its values are; None if they are no rows."""
        if home is None or "root" in vals.columns:
            return None
        if shape.path is None:
            holds = self._logic(c, home)
            if holds is None:
                return None
            broken = replace(home, frame=home.frame.where(~holds), whole=home.whole or home)
            self._explain(shape, c, broken)
            return broken.frame.select(home.subject.term().alias("focus")).withColumn("value", F.col("focus"))
        to = self.graph.pointed(home, shape.path.iri) if isinstance(shape.path, Predicate) and self.details is None else None
        if to is None:
            return None
        to, value = renamed(to, f"_t{next(self._number)}_"), self.graph.column_of(home, shape.path.iri)
        holds = self._logic(c, to, value)
        if holds is None:
            return None
        rows = home.frame.where(value["lex"].isNotNull())
        rows = rows.join(to.frame, F.col(home.predicates[shape.path.iri].column) == F.col(to.subject.column), "left")
        return rows.where(~holds).select(home.subject.term().alias("focus"), value.alias("value"))

    def _explain(self, shape: Shape, c: Constraint, broken: Mapping) -> None:
        """Keep the details of a logical constraint for the rows of a table that violate it; sh:not has none."""
        inner = c.params[c.name.lower()]
        if self.details is None or c.name == "Not":
            return
        for s in {s.node: s for s in (inner if isinstance(inner, (list, tuple)) else [inner])}.values():
            if s.deactivated and self.mode.deactivated_everywhere:
                continue
            rows = self.results(s, broken.frame.select(broken.subject.term().alias("focus")), home=broken)
            self.details.append((str(shape.node), c.component, rows, f"{shape.node} {c.component} {s.node}" if _once(s) else ""))

    def _by_key(self, constraints: list[Constraint], shape: Shape, siblings: tuple[Shape, ...], home: Mapping) -> tuple[DataFrame, dict] | None:
        """(focus, an aggregate for each constraint) of the rows of ``home``, whose values are rows of a table that point to them.

        One aggregation by the column that points, before it meets the foci. None if the path or a constraint is no such.
        """
        path, column = shape.path, None
        if isinstance(path, Sequence) and len(path.parts) == 2 and isinstance(path.parts[1], Predicate):
            path, column = path.parts
        if not (isinstance(path, Inverse) and isinstance(path.path, Predicate)):
            return None
        table = self.graph.pointing(home, path.path.iri)
        if table is None:
            return None
        if column is not None:
            column = self.graph.column_of(table, column.iri)
            if column is None or any(c.name != "HasValue" for c in constraints):
                return None  # other constraints count distinct values
        aggregates = {"n": F.count(F.lit(1))}
        for k, c in enumerate(constraints):
            if c.name == "HasValue":
                value = table.subject.term() if column is None else column
                aggregates[f"h{k}"] = F.max(F.coalesce(is_term(value, c.params["hasValue"]), F.lit(False)).cast("int"))
            elif c.name == "Qualified":
                if not self.mode.siblings_disjoint_only:
                    return None
                tests = [self.row_test(c.params["qualifiedValueShape"], table)]
                if c.params.get("qualifiedValueShapesDisjoint"):
                    others = [o.params["qualifiedValueShape"] for s in siblings for o in s.constraints if o.name == "Qualified"]
                    for o in others:
                        if o.node != c.params["qualifiedValueShape"].node:
                            t = self.row_test(o, table)
                            tests.append(None if t is None else ~t)
                if any(t is None for t in tests):
                    return None
                aggregates[f"q{k}"] = F.sum(reduce(and_, tests).cast("int"))
        key = F.col(table.predicates[path.path.iri].column)
        g = table.frame.where(key.isNotNull()).groupBy(key.alias("_key")).agg(*(a.alias(n) for n, a in aggregates.items()))
        rows = home.frame.select(F.col(home.subject.column).alias("_id"), home.subject.term().alias("focus"))
        return rows.join(g, F.col("_id") == F.col("_key"), "left").drop("_id", "_key"), aggregates

    def results(
        self, shape: Shape, foci: DataFrame, siblings: tuple[Shape, ...] = (), wide: bool = False, home: Mapping | None = None
    ) -> DataFrame:
        """All result rows of ``shape`` for distinct ``foci``: (focus), each its own root, or (root, focus).

        ``wide``: the foci are a class or so, not a few constants. ``home``: they are the rows of this table.
        """
        found: list[DataFrame] = []
        vals = self.values(shape.path, foci, home)
        local, counted, rest = [], [], []
        for c in shape.constraints:
            if c.name in LOCAL:
                local.append(c)
            elif c.name in COUNTED:
                counted.append(c)
            else:
                rest.append(c)
        if local:
            found.append(self._finish(shape, self._local(local, vals)))
        if counted:
            found.append(self._finish(shape, self._counted(counted, shape, foci, vals, siblings, wide, home)))
        for c in rest:
            fn = COMPONENTS.get(c.component) or (_sparql if c.params.get("custom") else OTHERS.get(c.name))
            if fn is None:
                raise ValueError(f"no evaluator for {c.component}")
            out = fn(self, shape, c, foci, vals, home)
            if out is not None:
                found.append(out if "shape" in out.columns else self._finish(shape, out, c))
        qualified = tuple(p for p in shape.properties if any(c.name == "Qualified" for c in p.constraints))
        for p in shape.properties:
            if p.deactivated and self.mode.deactivated_everywhere:
                continue
            if shape.path is None:
                found.append(self.results(p, foci, qualified, wide, home))
            else:
                root = F.col("root" if "root" in vals.columns else "focus")
                inner = vals.select(root.alias("root"), F.col("value").alias("focus")).distinct()
                found.append(self.results(p, inner, qualified))
        return reduce(DataFrame.unionByName, found) if found else self.none()

    def _finish(self, shape: Shape, rows: DataFrame, c: Constraint | None = None) -> DataFrame:
        """Result rows of violations: adds what a shape says of all of them."""
        has = set(rows.columns)
        own = F.array(*map(F.lit, shape.messages)) if shape.messages else F.array().cast("array<string>")
        message = F.array("message") if "message" in has else F.array().cast("array<string>")
        path = F.col("path") if "path" in has else F.lit(shape.path_text or (str(shape.path) if shape.path else None)).cast("string")
        return rows.select(
            F.col("root" if "root" in has else "focus").alias("root"),
            "focus",
            path.alias("path"),
            (F.col("value") if "value" in has else F.expr(NO_TERM)).alias("value"),
            (F.col("component") if "component" in has else F.lit(c.component)).alias("component"),
            (F.col("detail") if "detail" in has else F.lit("" if c is None else str(c))).alias("detail"),
            F.array_distinct(F.filter(F.concat(message, own), lambda x: x.isNotNull())).alias("messages"),
            F.lit(str(shape.node)).alias("shape"),
            F.lit(shape.name).alias("name"),
            F.lit(shape.severity).alias("severity"),
            (F.col("trace") if "trace" in has else F.array().cast("array<string>")).alias("trace"),
            F.lit(None if c is None or c.params.get("custom") or "source" not in c.params else str(c.params["source"])).cast("string").alias("source"),
        )

    # one value at a time ----------------------------------------------------------------------------------------

    def _local(self, constraints: list[Constraint], vals: DataFrame) -> DataFrame:
        """One pass for all constraints that look at one value."""
        tests = []
        for c in constraints:
            for broken, message in LOCAL[c.name](self, c, F.col("value")):
                tests.append((c, F.coalesce(broken, F.lit(False)), message))
        if not tests:
            return vals.where("false").withColumns({x: F.lit("") for x in ("component", "detail", "message")})
        made = lambda c, m: F.struct(F.lit(c.component).alias("component"), F.lit(str(c)).alias("detail"), F.lit(m).alias("message"))
        if len(tests) == 1:
            c, broken, m = tests[0]
            return vals.where(broken).withColumn("_x", made(c, m)).select(*ids(vals), "value", "_x.*")
        any_ = reduce(or_, [b for _, b, _ in tests])
        each = F.filter(F.array(*(F.when(b, made(c, m)) for c, b, m in tests)), lambda x: x.isNotNull())
        return vals.where(any_).withColumn("_x", F.explode(each)).select(*ids(vals), "value", "_x.*")

    # all values of a focus ---------------------------------------------------------------------------------------

    def _counted(
        self, constraints: list[Constraint], shape: Shape, foci: DataFrame, vals: DataFrame, siblings, wide: bool, home
    ) -> DataFrame:
        """One aggregation for all constraints that count a focus's values."""
        aggregates, checks, rows = {"n": F.count("value")}, [], vals
        of_one = {"n": F.col("value").isNotNull().cast("int")}  # the same of at most one value
        by_key = self._by_key(constraints, shape, siblings, home) if home is not None and "root" not in foci.columns else None
        for i, c in enumerate(constraints):
            p = c.params
            if c.name == "MinCount":
                checks.append((c, F.coalesce("n", F.lit(0)) < p["minCount"], f"has fewer than {p['minCount']} values"))
            elif c.name == "MaxCount":
                checks.append((c, F.coalesce("n", F.lit(0)) > p["maxCount"], f"has more than {p['maxCount']} values"))
            elif c.name == "HasValue":
                k = f"h{i}"
                of_one[k] = is_term(F.col("value"), p["hasValue"]).cast("int")
                aggregates[k] = F.max(of_one[k])
                checks.append((c, F.coalesce(k, F.lit(0)) == 0, f"lacks the value {p['hasValue']}"))
            elif c.name == "Qualified":
                inner: Shape = p["qualifiedValueShape"]
                k, low, high = f"q{i}", p.get("qualifiedMinCount"), p.get("qualifiedMaxCount")
                if low is not None:
                    one = Constraint(c.component.replace("Qualified", "QualifiedMinCount"), p)
                    checks.append((one, F.coalesce(k, F.lit(0)) < low, f"has fewer than {low} values of the qualified shape"))
                if high is not None:
                    one = Constraint(c.component.replace("Qualified", "QualifiedMaxCount"), p)
                    checks.append((one, F.coalesce(k, F.lit(0)) > high, f"has more than {high} values of the qualified shape"))
                if by_key is not None:
                    continue
                nodes = vals.select("value").distinct()
                bad = self.failing(inner, nodes).select(F.col("value").alias("_b")).withColumn("_f", F.lit(1))
                rows = rows.join(bad, same(F.col("value"), F.col("_b")), "left").withColumn(f"_{k}", F.col("_f").isNull()).drop("_b", "_f")
                ok = F.col(f"_{k}")
                if not self.mode.siblings_disjoint_only:
                    ok = ok & (F.col("value.kind") != "literal")
                if p.get("qualifiedValueShapesDisjoint"):
                    for s in siblings:
                        for other in s.constraints:
                            if other.name != "Qualified" or other.params["qualifiedValueShape"].node == inner.node:
                                continue
                            wrong = self.failing(other.params["qualifiedValueShape"], nodes).select(F.col("value").alias("_b")).withColumn("_f", F.lit(1))
                            m = f"_s{next(self._number)}"
                            rows = rows.join(wrong, same(F.col("value"), F.col("_b")), "left").withColumn(m, F.col("_f").isNull()).drop("_b", "_f")
                            ok = ok & ~F.col(m)
                aggregates[k] = F.sum(ok.cast("int"))
        made_of = [a.alias(k) for k, a in aggregates.items()]
        if by_key is not None:
            whole = by_key[0]
        elif shape.path is None:
            whole = rows.groupBy(*ids(rows)).agg(*made_of)
        elif home is not None and rows is vals and isinstance(shape.path, Predicate) and (one := self.graph.column_of(home, shape.path.iri)) is not None:
            # a column has one value or none a row, so there is nothing to group
            row = home.frame.select(home.subject.term().alias("focus"), one.alias("value"))
            row = row.withColumn("value", F.when(F.col("value.lex").isNotNull(), F.col("value")))
            whole = row.select("focus", *(x.alias(k) for k, x in of_one.items()))
        elif wide and rows is vals and paths.single(shape.path):
            # a predicate's pairs are counted where they lie, before they meet the foci
            edges = paths.pairs(shape.path, self.graph)
            g = edges.select(paths.node_key(F.col("s")).alias("_k"), F.col("o").alias("value")).groupBy("_k").agg(*made_of)
            whole = foci.join(g, paths.node_key(F.col("focus")) == F.col("_k"), "left").drop("_k")
        else:
            names = ids(rows)
            g = rows.groupBy(*names).agg(*made_of).withColumnsRenamed({x: f"_{x}" for x in names})
            on = reduce(and_, [same(F.col(x), F.col(f"_{x}")) for x in names])
            whole = foci.join(g, on, "left").drop(*(f"_{x}" for x in names))
        made = lambda c, m: F.struct(F.lit(c.component).alias("component"), F.lit(str(c)).alias("detail"), F.lit(m).alias("message"))
        each = F.filter(F.array(*(F.when(b, made(c, m)) for c, b, m in checks)), lambda x: x.isNotNull())
        return whole.where(reduce(or_, [b for _, b, _ in checks])).withColumn("_x", F.explode(each)).select(*ids(whole), "_x.*")

    # helpers ------------------------------------------------------------------------------------------------------

    def below(self, start: str, p: str) -> list[str]:
        if (start, p) not in self._below:
            self._below[start, p] = self.graph.below(start, p)
        return self._below[start, p]

    def other_values(self, path: Path, foci: DataFrame, home: Mapping | None = None) -> DataFrame:
        """``foci`` with ``other``: the values of another path."""
        return self.values(path, foci, home).withColumnRenamed("value", "other")


def _once(shape: Shape) -> bool:
    """Whether no result of the shape can repeat for a root."""
    known = all(c.name in LOCAL or c.name in COUNTED or c.name in LOGIC for c in shape.constraints)
    parts = [(c.component, str(c)) for c in shape.constraints] + [p.node for p in shape.properties]
    return known and len(set(parts)) == len(parts) and all(p.path is not None and not p.properties and _once(p) for p in shape.properties)


def ids(frame: DataFrame) -> list[str]:
    """The columns that tell the question a row belongs to: the focus, and the root where it isn't the focus."""
    return [c for c in ("root", "focus") if c in frame.columns]


# value-local constraints: lists of (broken, message) -----------------------------------------------------------------


def _datatype(k: Compiler, c: Constraint, v: Column):
    d = c.params["datatype"].lex
    bad = (v["kind"] != "literal") | (v["dt"] != d)
    if k.mode.datatype_well_formed:
        bad = bad | ~V.well_formed(v, d)
    yield bad, f"is no {V.local_name(d)}"


KINDS = {
    "IRI": ("iri",), "BlankNode": ("bnode",), "Literal": ("literal",), "BlankNodeOrIRI": ("bnode", "iri"),
    "BlankNodeOrLiteral": ("bnode", "literal"), "IRIOrLiteral": ("iri", "literal"),
}


def _node_kind(k, c, v):
    yield ~v["kind"].isin(*KINDS[V.local_name(c.params["nodeKind"].lex)]), f"is not of kind {V.local_name(c.params['nodeKind'].lex)}"


def _bound(name: str, op: str):
    def test(k, c, v):
        bound = c.params[name]
        yield ~V.compare(v, bound.column(), op, k.mode.compare_by_datatype), f"is not {op} {bound.lex}"

    return test


def _length(name: str, short: bool):
    def test(k, c, v):
        n = c.params[name]
        size = V.text_length(v, not k.mode.length_in_characters)
        wrong = size < n if short else size > n
        kinds = ("literal", "iri") if k.mode.length_in_characters else ("literal",)
        bad = v["kind"].isin(*kinds) & wrong
        if k.mode.length_in_characters:
            bad = bad | (v["kind"] == "bnode")
        yield bad, f"is {'shorter' if short else 'longer'} than {n}"

    return test


def _pattern(k, c, v):
    pattern = V.java_pattern(c.params["pattern"], c.params.get("flags", ""))
    if pattern is None:
        if k.mode.pattern_on_iris:
            yield F.lit(True), f"can't match the ill-formed pattern {c.params['pattern']}"
        return
    kinds = ("literal", "iri") if k.mode.pattern_on_iris else ("literal",)
    bad = v["kind"].isin(*kinds) & ~V.matches(v, pattern)
    if k.mode.pattern_on_iris:
        bad = bad | (v["kind"] == "bnode")
    yield bad, f"doesn't match {c.params['pattern']}"


def _language_in(k, c, v):
    tags = c.params["languageIn"]
    if k.mode.language_ranges:
        yield ~reduce(or_, [V.lang_matches(v["lang"], t) for t in tags], F.lit(False)) | (v["lang"] == ""), "has another language"
    else:
        yield (v["kind"] == "literal") & ~F.lower(v["lang"]).isin([t.lower() for t in tags]), "has another language"


def _in(k, c, v):
    yield ~in_terms(v, c.params["in"]), "is not in the list"


LOCAL = {
    "Datatype": _datatype,
    "NodeKind": _node_kind,
    "MinExclusive": _bound("minExclusive", ">"),
    "MinInclusive": _bound("minInclusive", ">="),
    "MaxExclusive": _bound("maxExclusive", "<"),
    "MaxInclusive": _bound("maxInclusive", "<="),
    "MinLength": _length("minLength", True),
    "MaxLength": _length("maxLength", False),
    "Pattern": _pattern,
    "LanguageIn": _language_in,
    "In": _in,
}
COUNTED = ("MinCount", "MaxCount", "HasValue", "Qualified")
#: Logical constraints: whether they hold, of whether the inner shapes do.
LOGIC = {
    "Node": lambda tests: tests[0],
    "And": lambda tests: reduce(and_, tests, F.lit(True)),
    "Or": lambda tests: reduce(or_, tests, F.lit(False)),
    "Xone": lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests], F.lit(0)) == 1,
    "Not": lambda tests: ~tests[0],
}


# constraints with plans of their own ------------------------------------------------------------------------------


def _class(k: Compiler, shape: Shape, c: Constraint, foci: DataFrame, vals: DataFrame, home=None) -> DataFrame:
    cls = c.params["class"].lex
    classes = k.below(cls, SUBCLASS) if k.mode.class_by_subclass else [cls]
    good = k.graph.instances(classes).select(F.col("s").alias("_s"))
    out = vals.join(good, same(F.col("value"), F.col("_s")), "left_anti")
    return out.withColumn("message", F.lit(f"is no instance of {cls}"))


def _unique_lang(k, shape, c, foci, vals, home=None):
    if not c.params["uniqueLang"] and k.mode.unique_lang_flag:
        return None
    tagged = vals.where("value.lang <> ''")
    by = Window.partitionBy(*ids(vals), "value.lang").orderBy("value.lex")
    if k.mode.unique_lang_flag:
        # one result for each tag that is used more than once
        many = tagged.groupBy(*ids(vals), F.col("value.lang").alias("lang")).agg(F.count("*").alias("n")).where("n > 1")
        return many.select(*ids(vals), F.concat(F.lit("repeats the language "), "lang").alias("message"))
    again = tagged.withColumn("_n", F.row_number().over(by)).where("_n > 1").drop("_n")
    return again.withColumn("message", F.lit("repeats a language"))


def _matching(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Rows of ``a`` (root, focus, value) with (semi) or without (anti) an equal row in ``b``."""
    x, y = a.alias("x"), b.alias("y")
    on = reduce(and_, [same(F.col(f"x.{t}"), F.col(f"y.{t}")) for t in (*ids(a), "value")])
    return x.join(y, on, how)


def _equals(k, shape, c, foci, vals, home=None):
    other = k.values(c.params["equals"], foci, home)
    left, right = _matching(vals, other, "left_anti"), _matching(other, vals, "left_anti")
    name = str(c.params["equals"])
    if k.mode.equals_as_sets:
        return left.unionByName(right.select(*left.columns)).withColumn("message", F.lit(f"is not a value of both paths: {name}"))
    found = []
    if shape.is_property:
        ends = left.select(*ids(left)).unionByName(right.select(*ids(left))).distinct()
        found.append(ends.withColumn("value", F.expr(NO_TERM)))
    names = ids(foci)
    on = reduce(and_, [same(F.col(f"x.{t}"), F.col(f"y.{t}")) for t in names])
    bare = foci.alias("x").join(other.select(*names).distinct().alias("y"), on, "left_anti")
    found.append(bare.select(*names, F.expr(NO_TERM).alias("value")))
    found.append(other.where(~same(F.col("value"), F.col("focus"))).select(*names, "value"))
    return reduce(DataFrame.unionByName, found).withColumn("message", F.lit(f"is not equal to {name}"))


def _disjoint(k, shape, c, foci, vals, home=None):
    other = k.values(c.params["disjoint"], foci, home)
    return _matching(vals, other, "left_semi").withColumn("message", F.lit(f"is also a value of {c.params['disjoint']}"))


def _less(name: str, op: str):
    def test(k, shape, c, foci, vals, home=None):
        names = ids(foci)
        rows = k.rows_with(home, shape.path, c.params[name]) if home is not None and "root" not in names else None
        if rows is not None:
            # two values of a row
            frame, (value, other) = rows
            both = frame.select(home.subject.term().alias("focus"), value.alias("value"), other.alias("other"))
            both = both.where("value is not null and other is not null")
        else:
            other = k.other_values(c.params[name], foci, home).withColumnsRenamed({x: f"_{x}" for x in names})
            on = reduce(and_, [same(F.col(x), F.col(f"_{x}")) for x in names])
            both = vals.join(other, on).drop(*(f"_{x}" for x in names))
        holds = V.compare(F.col("value"), F.col("other"), op, k.mode.compare_by_datatype)
        text = F.lit(f"is not {op} the values of {c.params[name]}")
        if k.mode.less_than_each_pair:
            return both.where(~holds).select(*names, "value", text.alias("message"))
        some = both.groupBy(*names, "value").agg(F.bool_or(holds).alias("_any")).where("not _any")
        return some.select(*names, "value", text.alias("message"))

    return test


def _failing_values(k: Compiler, vals: DataFrame, shapes: list[Shape], keep, outer=None) -> DataFrame:
    """Rows of ``vals`` for which ``keep`` holds of the number of shapes to which the value conforms.

    The distinct values are asked once a shape; a shape listed twice counts twice.
    """
    nodes = vals.select("value").distinct()
    bad = [k.failing(s, nodes, outer=outer).select("value") for s in shapes]
    counts = reduce(DataFrame.unionByName, bad).groupBy("value").agg(F.count("*").alias("_bad"))
    b = counts.withColumnRenamed("value", "_v")
    rows = vals.join(b, same(F.col("value"), F.col("_v")), "left").drop("_v")
    return rows.where(keep(F.lit(len(shapes)) - F.coalesce("_bad", F.lit(0)))).drop("_bad")


def _traced(rows: DataFrame, what: str, message: str) -> DataFrame:
    return rows.withColumn("trace", F.array(F.lit(what))).withColumn("message", F.lit(message))


def _node(k, shape, c, foci, vals, home=None):
    inner: Shape = c.params["node"]
    if (rows := k.logical(shape, c, vals, home)) is not None:
        return rows.withColumn("message", F.lit(f"doesn't conform to {inner.node}"))
    out = _failing_values(k, vals, [inner], lambda n: n == 0, (shape, c))
    if not k.mode.siblings_disjoint_only:
        out = out.unionByName(vals.where("value.kind = 'literal'")).distinct()
    return out.withColumn("message", F.lit(f"doesn't conform to {inner.node}"))


def _and(k, shape, c, foci, vals, home=None):
    some = c.params["and"]
    rows = k.logical(shape, c, vals, home)
    return _traced(rows if rows is not None else _failing_values(k, vals, some, lambda n: n < len(some), (shape, c)), "sh:and validation", "doesn't conform to all shapes")


def _or(k, shape, c, foci, vals, home=None):
    """Successive narrowing: a shape is asked only about values that failed all shapes before it."""
    if (rows := k.logical(shape, c, vals, home)) is not None:
        return _traced(rows, "sh:or validation", "conforms to none of the shapes")
    nodes = vals.select("value").distinct()
    for i, s in enumerate(c.params["or"]):
        nodes = k.failing(s, nodes, narrowed=i > 1, outer=(shape, c))
    n = nodes.select(F.col("value").alias("_v"))
    return _traced(vals.join(n, same(F.col("value"), F.col("_v")), "left_semi"), "sh:or validation", "conforms to none of the shapes")


def _xone(k, shape, c, foci, vals, home=None):
    rows = k.logical(shape, c, vals, home)
    return _traced(rows if rows is not None else _failing_values(k, vals, c.params["xone"], lambda n: n != 1, (shape, c)), "sh:xone validation", "doesn't conform to exactly one shape")


def _not(k, shape, c, foci, vals, home=None):
    inner = c.params["not"]
    rows = k.logical(shape, c, vals, home)
    return _traced(rows if rows is not None else _failing_values(k, vals, [inner], lambda n: n == 1), "sh:not validation", f"conforms to {inner.node}")


def _closed(k, shape, c, foci, vals, home=None):
    if shape.is_property and not k.mode.closed_on_properties:
        return None
    allowed = set(c.params["ignored"])
    for p in shape.properties:
        allowed |= paths.direct_predicates(p.path, not k.mode.closed_direct_only)
    on_rows = home is not None and not shape.is_property and "root" not in vals.columns
    own = k.graph.triples_of(home) if on_rows else None
    t = (own if own is not None else k.graph.triples()).where(~F.col("p").isin(sorted(allowed)) if allowed else F.lit(True))
    if own is not None and not any(s.lex.startswith(home.subject.base) for s, _, _ in k.graph.extra):
        # the foci are the rows that the triples are read from
        out = t.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"))
    else:
        t = t.select(F.col("s").alias("_s"), F.col("p").alias("path"), F.col("o").alias("_o"))
        v = vals.where("value.kind <> 'literal'")
        out = v.join(t, same(F.col("value"), F.col("_s"))).select(*ids(vals), "path", F.col("_o").alias("value"))
    if k.mode.closed_reports_predicate:
        out = out.withColumn("path", F.concat(F.lit("<"), "path", F.lit(">")))
    else:
        out = out.drop("path")
    return out.withColumn("message", F.lit("has a predicate that the shape doesn't allow"))


def _sparql(k, shape, c, foci, vals, home=None):
    from ..sparql.constraint import evaluate

    if "root" not in foci.columns:
        foci, vals = (x.withColumn("root", F.col("focus")) for x in (foci, vals))
    return evaluate(k, shape, c, foci, vals)


OTHERS = {
    "Class": _class,
    "UniqueLang": _unique_lang,
    "Equals": _equals,
    "Disjoint": _disjoint,
    "LessThan": _less("lessThan", "<"),
    "LessThanOrEquals": _less("lessThanOrEquals", "<="),
    "Node": _node,
    "And": _and,
    "Or": _or,
    "Xone": _xone,
    "Not": _not,
    "Closed": _closed,
    "SPARQL": _sparql,
}
