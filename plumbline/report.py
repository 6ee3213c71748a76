"""Validation reports: a DataFrame of results, and its sinks."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Triple
from .plans.ir import Alternative, Inverse, Path, Predicate, Sequence
from .sources.readers import read_triples, to_text
from .terms import RDF, SH, XSD, Term, bnode, iri, literal, literal_column, text_of

LEVELS = ("Violation", "Warning", "Info")


def rendered(results: DataFrame) -> DataFrame:
    """Result rows with terms as N-Triples text. A result that several values of an outer path lead to is one for each."""
    return results.select(
        text_of(F.col("focus")).alias("focus"),
        "path",
        text_of(F.col("value")).alias("value"),
        "severity",
        F.col("shape").alias("source_shape"),
        F.col("name").alias("source_shape_name"),
        "component",
        "detail",
        "messages",
        "trace",
        F.col("source").alias("source_constraint"),
    )


#: What a result and its details share: the value that an inner shape was asked about, by which constraint.
PARENT = ("source_shape", "component", "value")


class Report:
    """The results of a run. Nothing is computed before it is asked for.

    ``inner`` are (shape, component, result rows, key) of the shapes inside constraints, whose roots are the values. With a
    key the rows are just those that explain something; they are distinct, too, if the key is no other's and not empty.
    """

    def __init__(self, results: DataFrame, inner: Iterable[tuple[str, str, DataFrame, str | None]] = ()) -> None:
        self.results = rendered(results)
        self.inner = list(inner)

    def details(self) -> DataFrame:
        """Results of inner shapes as the columns of ``results``, with ``parent_shape``, ``parent_component`` and
        ``parent_value`` of the results, or of other details, that they explain."""
        names = [f"parent_{c.removeprefix('source_')}" for c in PARENT]
        if not self.inner:
            return self.results.limit(0).select("*", *(F.lit(None).cast("string").alias(n) for n in names))
        sure, exact, loose = [], [], []
        times = Counter(key for *_, key in self.inner)
        for shape, component, rows, key in self.inner:
            one = rendered(rows.withColumn("name", F.struct("name", text_of(F.col("root")).alias("root"))))
            one = one.withColumn(names[2], F.col("source_shape_name.root")).withColumn("source_shape_name", F.col("source_shape_name.name"))
            one = one.withColumns({names[0]: F.lit(shape), names[1]: F.lit(component)})
            (loose if key is None else sure if key and times[key] == 1 else exact).append(one)
        found = sure + ([reduce(DataFrame.unionByName, exact).distinct()] if exact else [])
        if loose:
            all_ = reduce(DataFrame.unionByName, loose).distinct()
            keys = [c.alias(f"_{n}") for c, n in zip(map(F.col, PARENT), names, strict=True)]
            known = reduce(DataFrame.unionByName, [x.select(*keys) for x in (self.results, all_, *found)]).distinct()
            on = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
            found.append(all_.join(known, on, "left_semi"))
        return reduce(DataFrame.unionByName, found)

    @property
    def conforms(self) -> bool:
        """Whether there is no result; stops at the first one."""
        return self.results.select(F.lit(1)).limit(1).isEmpty()

    def by_severity(self) -> DataFrame:
        """(severity, n)."""
        return self.results.groupBy("severity").agg(F.count("*").alias("n"))

    def json_rows(self) -> DataFrame:
        """(value): one JSON object a result, for ``write.text``."""
        return self.results.select(F.to_json(self._object()).alias("value"))

    @staticmethod
    def _object() -> Column:
        return F.struct(
            F.col("focus").alias("focusNode"),
            F.col("path").alias("resultPath"),
            "value",
            F.col("severity").alias("resultSeverity"),
            F.col("source_shape").alias("sourceShape"),
            F.col("component").alias("sourceConstraintComponent"),
            F.col("messages").alias("resultMessage"),
            "trace",
            F.col("source_constraint").alias("sourceConstraint"),
        )

    def _nested(self, rows: list[dict]) -> list[tuple[dict, int | None]]:
        """Results and the details below them, each with the place of what it explains; small reports only."""
        if not self.inner:
            return [(r, None) for r in rows]
        below: dict[tuple, list[dict]] = {}
        for r in sorted((r.asDict() for r in self.details().collect()), key=str):
            below.setdefault((r["parent_shape"], r["parent_component"], r["parent_value"]), []).append(r)
        out: list[tuple[dict, int | None]] = []

        def add(r: dict, parent: int | None, path: tuple) -> None:
            key = tuple(r[c] for c in PARENT)
            out.append((r, parent))
            at = len(out) - 1
            if key not in path:
                for d in below.get(key, ()):
                    add(d, at, (*path, key))

        for r in rows:
            add(r, None, ())
        return out

    def lines(self) -> DataFrame:
        """(value): the report as N-Triples lines that the executors make, without details. Only the distinct paths, which are
        as many as shapes and predicates name, and whether there is a result reach the driver."""
        spark = self.results.sparkSession
        node = F.concat(F.lit("_:r"), F.monotonically_increasing_id().cast("string"))
        line = lambda p, o, s=F.col("node"): F.concat(s, F.lit(f" <{p}> "), o, F.lit(" ."))
        at, extra = F.lit(None).cast("string"), []
        for i, row in enumerate(sorted(r.path for r in self.results.select("path").where("path is not null").distinct().collect())):
            at = F.when(F.col("path") == row, F.lit(str(path_node(parse_path(row), f"path{i}", extra)))).otherwise(at)
        iri_of = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
        each = [
            line(SH + "result", F.col("node"), F.lit("_:report")), line(RDF + "type", F.lit(f"<{SH}ValidationResult>")), line(SH + "focusNode", F.col("focus")),
            line(SH + "resultPath", F.col("at")), line(SH + "value", F.col("value")), line(SH + "resultSeverity", iri_of("severity")),
            line(SH + "sourceConstraintComponent", iri_of("component")), line(SH + "sourceShape", F.col("source_shape")),
            line(SH + "sourceConstraint", F.col("source_constraint")),
        ]
        said = F.transform("messages", lambda m: line(SH + "resultMessage", text_of(literal_column(m))))
        made = self.results.withColumn("node", node).withColumn("at", at).select(F.explode(F.filter(F.concat(F.array(*each), said), lambda x: x.isNotNull())).alias("value"))
        head = [(bnode("report"), RDF + "type", iri(SH + "ValidationReport")), (bnode("report"), SH + "conforms", literal(str(self.conforms).lower(), XSD + "boolean")), *extra]
        return spark.createDataFrame([(f"{s} <{p}> {o} .",) for s, p, o in head], "value string").unionByName(made)

    def write(self, path: str, fmt: str = "json") -> None:
        """Write the results to a folder from the executors: ``json``, an object a line, or ``nt``."""
        (self.json_rows() if fmt == "json" else self.lines()).write.text(path)

    def rows(self) -> list[dict]:
        """All results on the driver, in a stable order; for reports that a person reads."""
        order = ("source_shape", "focus", "path", "component", "value")
        return [r.asDict() for r in self.results.orderBy(*order).collect()]

    def to_json(self) -> str:
        if not self.inner:
            rows = [json.loads(r.value) for r in self.json_rows().orderBy("value").collect()]
            return json.dumps({"conforms": not rows, "results": rows}, indent=2, ensure_ascii=False)
        made: list[dict] = []
        nested = self._nested(self.rows())
        for r, parent in nested:
            shown = {name: r[c] for name, c in JSON if r[c] is not None}
            made.append(shown)
            if parent is not None:
                made[parent].setdefault("details", []).append(shown)
        top = [x for x, (_, parent) in zip(made, nested, strict=True) if parent is None]
        return json.dumps({"conforms": not top, "results": top}, indent=2, ensure_ascii=False)

    def to_text(self) -> str:
        rows = self.rows()
        n = Counter(r["severity"].rsplit("#", 1)[-1] for r in rows)
        out = [f"Conforms: {str(not rows).lower()}", f"Results: {len(rows)}"]
        out += [f"  {k}: {n[k]}" for k in [*LEVELS, *sorted(set(n) - set(LEVELS))] if n[k]]
        for i, r in enumerate(rows, 1):
            out.append(f"{i}. {r['severity'].rsplit('#', 1)[-1]} at {r['focus']}")
            out += [f"   {k}: {r[c]}" for k, c in (("path", "path"), ("value", "value"), ("shape", "source_shape"), ("constraint", "detail")) if r[c]]
            out += [f"   message: {m}" for m in r["messages"]]
        return "\n".join(out) + "\n"

    def to_triples(self) -> list[Triple]:
        """The report as RDF, details as sh:detail, paths as the standard writes them."""
        rows, report = self._nested(self.rows()), bnode("report")
        out: list[Triple] = [
            (report, RDF + "type", iri(SH + "ValidationReport")),
            (report, SH + "conforms", literal(str(not rows).lower(), XSD + "boolean")),
        ]
        for i, (r, parent) in enumerate(rows):
            node = bnode(f"result{i}")
            above = (report, SH + "result") if parent is None else (bnode(f"result{parent}"), SH + "detail")
            out += [(*above, node), (node, RDF + "type", iri(SH + "ValidationResult"))]
            out.append((node, SH + "focusNode", term(r["focus"])))
            if r["path"]:
                out.append((node, SH + "resultPath", path_node(parse_path(r["path"]), f"path{i}", out)))
            if r["source_constraint"]:
                out.append((node, SH + "sourceConstraint", term(r["source_constraint"])))
            if r["value"] is not None:
                out.append((node, SH + "value", term(r["value"])))
            out += [
                (node, SH + "resultSeverity", iri(r["severity"])),
                (node, SH + "sourceConstraintComponent", iri(r["component"])),
                (node, SH + "sourceShape", term(r["source_shape"])),
            ]
            out += [(node, SH + "resultMessage", literal(m)) for m in r["messages"]]
        return out

    def render(self, fmt: str = "text") -> str:
        """``text``, ``json`` or an RDF format."""
        if fmt == "text":
            return self.to_text()
        return self.to_json() if fmt == "json" else to_text(self.to_triples(), fmt)


#: Names of a result's members in JSON, and their columns.
JSON = (
    ("focusNode", "focus"), ("resultPath", "path"), ("value", "value"), ("resultSeverity", "severity"), ("sourceShape", "source_shape"),
    ("sourceConstraintComponent", "component"), ("resultMessage", "messages"), ("trace", "trace"), ("sourceConstraint", "source_constraint"),
)


def parse_path(text: str) -> Path:
    from .sparql.parser import Parser

    return Parser(text).alternative()


def path_node(path: Path, label: str, out: list[Triple]) -> Term:
    """The node of a path, as the shapes language writes it; the triples below it are appended to ``out``."""
    if isinstance(path, Predicate):
        return iri(path.iri)
    node = bnode(label)

    def items(parts: Iterable[Path], name: str) -> Term:
        head = iri(RDF + "nil")
        for i, p in reversed(list(enumerate(parts))):
            cell = bnode(f"{name}_{i}")
            out.extend([(cell, RDF + "first", path_node(p, f"{name}_{i}p", out)), (cell, RDF + "rest", head)])
            head = cell
        return head

    if isinstance(path, Sequence):
        return items(path.parts, label)
    if isinstance(path, Alternative):
        out.append((node, SH + "alternativePath", items(path.parts, label + "a")))
    elif isinstance(path, Inverse):
        out.append((node, SH + "inversePath", path_node(path.path, label + "i", out)))
    else:
        kind = "zeroOrOnePath" if not path.many else "oneOrMorePath" if path.least else "zeroOrMorePath"
        out.append((node, SH + kind, path_node(path.path, label + "c", out)))
    return node


def term(text: str) -> Term:
    """A term from its N-Triples text."""
    (_, _, o), = read_triples(f"<x:s> <x:p> {text} .", "ttl")
    return bnode(text[2:]) if text.startswith("_:") else o
