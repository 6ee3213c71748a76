"""Reading and writing RDF: shapes on the driver, data graphs as DataFrames.

Line formats are read by Spark and split over tasks; the others need a whole document, so a file is one task's row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import TRIPLE_SCHEMA, Triple, TripleGraph
from ..terms import RDF, SH, XSD, Term, make, number_of, text_of
from . import jsonld, turtle, xml
from .turtle import BASE, ParseError, Quad

#: Names of formats, and the format's short name.
ALIASES = {
    "turtle": "ttl", "ttl": "ttl", "ntriples": "nt", "n-triples": "nt", "nt": "nt", "nquads": "nq", "n-quads": "nq",
    "nq": "nq", "xml": "rdf", "rdfxml": "rdf", "rdf-xml": "rdf", "rdf": "rdf", "json-ld": "jsonld", "jsonld": "jsonld",
    "trig": "trig",
}


def format_of(name: str) -> str:
    """The short name of a format; raises ParseError for an unknown one."""
    short = ALIASES.get(name.strip().lower())
    if short is None:
        raise ParseError(f"unknown RDF format: {name}")
    return short


def quads_of(text: str, fmt: str, base: str = BASE, scope: str = "") -> list[Quad]:
    fmt = format_of(fmt)
    if fmt == "rdf":
        return xml.parse(text, base, scope)
    if fmt == "jsonld":
        return jsonld.parse(text, base, scope)
    return turtle.parse(text, fmt, base, scope)


def read_triples(text: str, fmt: str = "ttl", base: str = BASE) -> list[Triple]:
    """The distinct triples of a text, graph names dropped."""
    return list(dict.fromkeys((s, p, o) for s, p, o, _ in quads_of(text, fmt, base)))


def read_graph(spark: SparkSession, text: str, fmt: str = "ttl", base: str = BASE) -> TripleGraph:
    return TripleGraph.of(spark, read_triples(text, fmt, base))


def format_of_path(path: str) -> str:
    return format_of(os.path.splitext(path)[1].lstrip("."))


def read_triples_file(path: str, fmt: str | None = None) -> list[Triple]:
    """A small file, such as one of shapes, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return read_triples(f.read(), fmt or format_of_path(path))


def _term(c):
    """A term column from N-Triples text."""
    text = F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    lang = F.regexp_extract(c, r'"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)$', 1)
    dt = F.regexp_extract(c, r'"\^\^<([^<>]*)>$', 1)
    # a text without a backslash needs nothing; others are unescaped as JSON strings, which share the escapes
    plain = F.when(~text.contains("\\"), text).otherwise(
        F.get_json_object(F.concat(F.lit('{"x":"'), F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit("\t"), F.lit("\\t")), F.lit('"}')), "$.x")
    )
    full = F.when(lang != "", F.lit(RDF + "langString")).when(dt != "", dt).otherwise(F.lit(XSD + "string"))
    return (
        F.when(c.startswith("<"), make("iri", F.regexp_extract(c, r"^<(.*)>$", 1)))
        .when(c.startswith("_:"), make("bnode", F.substr(c, F.lit(3))))
        .otherwise(make("literal", plain, full, F.lower(lang), number_of(plain)))
    )


LINE = (
    r'^\s*(<[^<>"\x00-\x20]*>|_:[^\s<"]+)\s*(<[^<>"\x00-\x20]*>)\s*'
    r'(<[^<>"\x00-\x20]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?)'
    r'\s*(<[^<>"\x00-\x20]*>|_:[^\s<"]+)?\s*\.\s*(?:#.*)?$'
)


def _scope():
    """What a file's blank nodes are told apart by: its path or, for the parts that a writer dealt a graph into, their folder's."""
    name = F.input_file_name()
    whole = F.when(name.rlike(r"/part-[^/]*$"), F.regexp_replace(name, r"/part-[^/]*$", "")).otherwise(name)
    return F.concat(F.lit("f"), F.lower(F.hex(F.xxhash64(whole))), F.lit("_"))


def read_lines(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(s, p, o) of N-Triples or N-Quads files, split by line over tasks; fails on a line that is neither.

    Blank nodes of different files differ; the part files of one folder are one graph.
    """
    raw = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    rows = raw.where(F.trim("value") != "").where(~F.ltrim("value").startswith("#"))
    rows = rows.select("value", _scope().alias("scope"))
    bad = F.raise_error(F.concat(F.lit("no triple: "), F.col("value")))
    part = lambda k: F.regexp_extract("value", LINE, k)
    split = rows.select(
        F.when(F.col("value").rlike(LINE), part(1)).otherwise(bad).alias("a"), part(2).alias("b"), part(3).alias("c"), "scope"
    )
    scoped = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), F.col("scope"), F.substr(c, F.lit(3)))).otherwise(c)
    split = split.select(scoped(F.col("a")).alias("a"), "b", scoped(F.col("c")).alias("c"))
    return split.select(_term(F.col("a")).alias("s"), F.regexp_extract("b", "^<(.*)>$", 1).alias("p"), _term(F.col("c")).alias("o"))


def read_documents(spark: SparkSession, paths: list[str], fmt: str) -> DataFrame:
    """(s, p, o) of files in a document format, one file a task; blank nodes of different files differ."""
    raw = spark.read.option("wholetext", True).text(paths)
    files = raw.select("value", _scope().alias("scope"))

    def run(batches):
        import pandas as pd

        part = lambda t: {"kind": t.kind, "lex": t.lex, "dt": t.dt, "lang": t.lang, "num": t.num}
        for b in batches:
            for text, scope in zip(b["value"], b["scope"], strict=True):
                quads = dict.fromkeys((s, p, o) for s, p, o, _ in quads_of(text, fmt, BASE, scope))
                yield pd.DataFrame([(part(s), p, part(o)) for s, p, o in quads], columns=["s", "p", "o"])

    return files.mapInPandas(run, TRIPLE_SCHEMA)


def read_files(spark: SparkSession, paths: list[str], fmt: str | None = None) -> TripleGraph:
    """The union of files' triples as one graph, each triple once; formats by extension unless given."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(format_of(fmt) if fmt else format_of_path(p), []).append(p)
    frames = [read_lines(spark, some) if f in ("nt", "nq") else read_documents(spark, some, f) for f, some in by.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return TripleGraph(out)


def write_lines(frame: DataFrame, path: str) -> None:
    """(s, p, o) as N-Triples text files."""
    line = F.concat(text_of(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), text_of(F.col("o")), F.lit(" ."))
    frame.select(line.alias("value")).write.text(path)


def _xml(triples: list[Triple]) -> str:
    """RDF/XML: an element a subject. Raises ParseError for a predicate whose end is no XML name."""
    names: dict[str, str] = {RDF: "rdf", SH: "sh"}
    by: dict[Term, list[str]] = {}
    for s, p, o in triples:
        m = re.match(r"(.*?)([^\W\d][\w.-]*)$", p, re.DOTALL)
        if not m:
            raise ParseError(f"RDF/XML can't name the predicate <{p}>")
        tag = f"{names.setdefault(m[1], f'n{len(names)}')}:{m[2]}"
        if o.is_literal:
            kind = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.dt)}" if o.dt not in ("", XSD + "string") else ""
            text = escape(o.lex, {"\r": "&#13;"})
            by.setdefault(s, []).append(f"    <{tag}{kind}>{text}</{tag}>")
        else:
            by.setdefault(s, []).append(f"    <{tag} {'rdf:resource' if o.kind == 'iri' else 'rdf:nodeID'}={quoteattr(o.lex)}/>")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<rdf:RDF " + " ".join(f"xmlns:{k}={quoteattr(v)}" for v, k in names.items()) + ">"]
    for s, lines in by.items():
        out += [f"  <rdf:Description {'rdf:about' if s.kind == 'iri' else 'rdf:nodeID'}={quoteattr(s.lex)}>", *lines, "  </rdf:Description>"]
    return "\n".join([*out, "</rdf:RDF>", ""])


def to_text(triples: Iterable[Triple], fmt: str = "ttl", graph: str | None = None) -> str:
    """A small graph as text in any of the formats; TriG and N-Quads put it in the graph named, or in the default one."""
    fmt = format_of(fmt)
    triples = list(dict.fromkeys(triples))
    if fmt in ("nt", "nq"):
        end = f" <{graph}>" if graph and fmt == "nq" else ""
        return "".join(f"{s} <{p}> {o}{end} .\n" for s, p, o in triples)
    if fmt == "rdf":
        return _xml(triples)
    if fmt == "jsonld":
        import json

        nodes: dict[Term, dict] = {}
        for s, p, o in triples:
            n = nodes.setdefault(s, {"@id": s.lex if s.kind == "iri" else f"_:{s.lex}"})
            if o.is_literal:
                v = {"@value": o.lex, **({"@language": o.lang} if o.lang else {"@type": o.dt} if o.dt != XSD + "string" else {})}
            else:
                v = {"@id": o.lex if o.kind == "iri" else f"_:{o.lex}"}
            n.setdefault(p, []).append(v)
        return json.dumps(list(nodes.values()), indent=2, ensure_ascii=False)
    short = lambda x: f"sh:{x[len(SH):]}" if x.startswith(SH) and x[len(SH) :].isalnum() else f"<{x}>"
    show = lambda t: short(t.lex) if t.kind == "iri" else str(t)
    lines = [f"@prefix sh: <{SH}> .", ""]
    by: dict[Term, list[tuple[str, Term]]] = {}
    for s, p, o in triples:
        by.setdefault(s, []).append((p, o))
    named = fmt == "trig" and graph
    lines += [f"<{graph}> {{"] if named else []
    for s, some in by.items():
        lines.append(show(s) + " " + " ;\n    ".join(f"{'a' if p == RDF + 'type' else short(p)} {show(o)}" for p, o in some) + " .")
    lines += ["}"] if named else []
    return "\n".join(lines) + "\n"
