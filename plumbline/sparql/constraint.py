"""SPARQL constraints and components, each as one plan over all focus nodes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import SHAPES_GRAPH
from ..terms import TERM, iri, text_of
from .ast import Bind, Minus, Service, SubSelect, Values, walk
from .evaluate import Evaluator, Rows, col
from .parser import QueryError, parse_query

FORBIDDEN = (Minus, Service, Values)


def checked(text: str, prefixes: dict[str, str], path, bound: set[str], strict: bool):
    """The parsed query; raises QueryError for what pre-binding doesn't allow."""
    q = parse_query(text, prefixes, path)
    for p in walk(q.where):
        if isinstance(p, FORBIDDEN) and (strict or not isinstance(p, Values)):
            raise QueryError(f"{type(p).__name__} is not allowed in a constraint")
        if isinstance(p, SubSelect) and not (strict and (p.query.star or {"this"} <= {n for n, _ in p.query.select})):
            raise QueryError("a nested SELECT has to return $this")
        if isinstance(p, Bind) and p.name in bound:
            raise QueryError(f"?{p.name} is bound by the constraint")
    for n, e in q.select or ():
        if n in bound and getattr(e, "name", None) != n:
            raise QueryError(f"?{n} is bound by the constraint")
    return q


def message_of(template: str, rows: DataFrame):
    """The template with ``{?var}`` and ``{$var}`` replaced by values; IRIs without brackets."""
    parts, names = re.split(r"\{[?$](\w+)\}", template), set(rows.columns)
    made = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            made.append(F.lit(p))
        elif col(p) in names:
            made.append(F.coalesce(F.col(col(p))["lex"], F.lit("")))
        else:
            made.append(F.lit("{?" + p + "}"))
    return F.concat(*made)


def evaluate(k, shape, c, foci: DataFrame, vals: DataFrame) -> DataFrame:
    """Violations of a ``sh:sparql`` constraint or of a component declared in SPARQL."""
    p, strict = c.params, k.mode.sparql_result_columns
    custom = p.get("custom", False)
    per_value = (custom and p["ask"]) or (shape.is_property and not strict) or (custom and not shape.is_property)
    start = vals.select("root", "focus", F.col("focus").alias(col("this")), F.col("value").alias(col("value"))) if per_value else foci.select(
        "root", "focus", F.col("focus").alias(col("this"))
    )
    constants = {"shapesGraph": iri(SHAPES_GRAPH), "currentShape": shape.node, **p["binding"]}
    for name, t in constants.items():
        start = start.withColumn(col(name), t.column())
    bound = {"this", *constants} | ({"value"} if per_value else set())
    try:
        q = checked(p["query"], p["prefixes"], shape.path, bound, strict)
    except QueryError as e:
        if strict:
            raise
        return foci.withColumn("value", F.expr(f"CAST(NULL AS {TERM})")).withColumn("message", F.lit(str(e)))
    start = start.distinct()
    ev = Evaluator(k.dataset, start, constants)
    if q.select is None:
        found = ev.group(q.where, Rows(start), k.graph)
        rows = ev.matching(start, found.frame, "left_anti")
    else:
        rows = ev.select(q, Rows(start)).frame
    text = p["messages"][0] if p["messages"] else ""
    message = message_of(text, rows) if text else F.lit("violates a SPARQL constraint")
    has = set(rows.columns)
    if col("value") in has:
        value = F.coalesce(F.col(col("value")), F.expr(f"CAST(NULL AS {TERM})") if shape.is_property else F.col("focus"))
    else:
        value = F.expr(f"CAST(NULL AS {TERM})") if shape.is_property else F.col("focus")
    out = {"value": value, "message": message}
    if strict and col("path") in has and not shape.is_property:
        out["path"] = text_of(F.col(col("path")))
    return rows.select("root", "focus", *(v.alias(n) for n, v in out.items()))

