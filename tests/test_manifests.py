"""Cases written as test manifests: a data graph, a shapes graph and the report expected of them, compared as multisets.

A case file holds a manifest with entries, or includes other files. ``<>`` as a graph means the file itself.
"""

from collections import Counter
from pathlib import Path

import pytest

from plumbline.api import validate_triples
from plumbline.graph import TripleGraph
from plumbline.plans.shapes import ShapeError, ShapesGraph
from plumbline.report import parse_path, term
from plumbline.sources.readers import read_triples
from plumbline.sparql.parser import QueryError
from plumbline.terms import RDF, RDFS, SH, iri

MF, SHT = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#", "http://www.w3.org/ns/shacl-test#"
CASES = Path(__file__).parent / "cases"


def entries(path: Path, seen: set | None = None) -> list[tuple[ShapesGraph, Path, object]]:
    """The approved entries of a manifest and of those it includes, each once."""
    seen = set() if seen is None else seen
    if path in seen:
        return []
    seen.add(path)
    g = ShapesGraph(read_triples(path.read_text(), "ttl", path.as_uri()))
    out = []
    for m, kind in g.of[RDF + "type"]:
        if kind != iri(MF + "Manifest"):
            continue
        for x in g.all(m, MF + "include"):
            out += entries(Path(x.lex.removeprefix("file://")), seen)
        for head in g.all(m, MF + "entries"):
            out += [(g, path, x) for x in g.items(head) if g.one(x, MF + "status") == iri(SHT + "approved")]
    return out


ALL = entries(CASES / "manifest.ttl")


def graph_of(g, entry, name, path):
    x = g.one(g.one(entry, MF + "action"), SHT + name)
    file = Path(x.lex.removeprefix("file://"))
    return g.triples if file == path else read_triples(file.read_text(), "ttl", file.as_uri())


def blind(x):
    """Blank nodes have no names of their own."""
    return None if x is None else "_" if x.kind == "bnode" else str(x)


def expected(g, result):
    rows = Counter()
    for r in g.all(result, SH + "result"):
        path = g.one(r, SH + "resultPath")
        rows[
            blind(g.one(r, SH + "focusNode")), str(g.path(path)) if path is not None else None, blind(g.one(r, SH + "value")),
            str(g.one(r, SH + "resultSeverity")), str(g.one(r, SH + "sourceConstraintComponent")), blind(g.one(r, SH + "sourceShape")),
        ] += 1
    return rows


@pytest.mark.parametrize("case", range(len(ALL)), ids=[(g.text(x, RDFS + "label") or x.lex) for g, _, x in ALL])
def test_case(spark, case):
    g, path, entry = ALL[case]
    data, shapes, result = graph_of(g, entry, "dataGraph", path), graph_of(g, entry, "shapesGraph", path), g.one(entry, MF + "result")
    if result == iri(SHT + "Failure"):
        with pytest.raises((QueryError, ShapeError)):
            validate_triples(TripleGraph.of(spark, data), shapes).rows()
        return
    report = validate_triples(TripleGraph.of(spark, data), shapes)
    got = Counter()
    for r in report.rows():
        shown = lambda x: blind(term(x)) if x is not None else None
        way = str(parse_path(r["path"])) if r["path"] else None
        got[shown(r["focus"]), way, shown(r["value"]), f"<{r['severity']}>", f"<{r['component']}>", shown(r["source_shape"])] += 1
    assert got == expected(g, result)
    assert report.conforms == (g.text(result, SH + "conforms") == "true") == (not got)
