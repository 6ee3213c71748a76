"""RDF grammars, writers, mapped tables, command line, tool server and streams."""

import io
import json

import pytest

from plumbline import Dataset, Iri, Literal, MappedGraph, Mapping, TripleGraph, lint_graph, lint_shapes_graph, validate
from plumbline.__main__ import main
from plumbline.plans.shapes import parse_shapes
from plumbline.server import answer
from plumbline.sources import readers
from plumbline.terms import RDF, XSD, bnode, iri, literal

E = "http://e/"
TTL = '''@prefix e: <http://e/> . @base <http://b/x> .
e:a a e:T ; e:p 1, 1.5, 2e3, true, "x", 'y'@en-GB, """l"o
ng""", "\\u00e9\\n"^^e:d ; e:l ( 1 <rel> ) ; e:b [ e:q _:k ] .
[] e:q e:c\\,d . # comment
PREFIX f: <http://f/>
f: f:x.y <> .
'''


def test_turtle():
    t = readers.read_triples(TTL)
    a = iri(E + "a")
    values = {o for s, p, o in t if s == a and p == E + "p"}
    assert values == {
        literal("1", XSD + "integer"), literal("1.5", XSD + "decimal"), literal("2e3", XSD + "double"), literal("true", XSD + "boolean"),
        literal("x"), literal("y", "", "en-gb"), literal('l"o\nng'), literal("é\n", E + "d"),
    }
    assert (a, RDF + "type", iri(E + "T")) in t and (iri("http://f/"), "http://f/x.y", iri("http://b/x")) in t
    assert any(o == iri("http://b/rel") for _, p, o in t if p == RDF + "first")
    assert any(o == iri(E + "c,d") for _, _, o in t)


def test_other_formats():
    nq = '<http://e/a> <http://e/p> "x\\ty"@EN <http://e/g> .\n# c\n_:b <http://e/p> <http://e/a> .\n'
    assert readers.read_triples(nq, "N-Quads") == [(iri(E + "a"), E + "p", literal("x\ty", "", "en")), (bnode("b"), E + "p", iri(E + "a"))]
    assert [q[3] for q in readers.quads_of("@prefix e: <http://e/> . e:g { e:a e:p 1 } e:b e:p 2 . GRAPH e:h { e:c e:p 3 . }", "trig")] == [E + "g", "", E + "h"]
    xml = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:T r:about="http://e/a" e:n="v">
    <e:p r:resource="http://e/b"/><e:q r:datatype="http://e/d">1</e:q><e:l r:parseType="Collection"><r:Description r:about="http://e/c"/></e:l></e:T></r:RDF>"""
    t = readers.read_triples(xml, "rdf-xml")
    assert (iri(E + "a"), RDF + "type", iri(E + "T")) in t and (iri(E + "a"), E + "q", literal("1", E + "d")) in t and len(t) == 7
    ld = {"@context": {"@vocab": E, "knows": {"@type": "@id"}, "ls": {"@container": "@list"}}, "@id": "http://e/a", "@type": "T", "knows": "http://e/b", "n": [1, 1.5, True, {"@value": "x", "@language": "EN"}], "ls": [1, 2]}
    t = readers.read_triples(json.dumps(ld), "json-ld")
    assert (iri(E + "a"), E + "knows", iri(E + "b")) in t and (iri(E + "a"), E + "n", literal("x", "", "en")) in t and len(t) == 11
    for bad, fmt in (("e:a e:b 1 .", "ttl"), ("<a> <b> .", "nt"), ("{", "jsonld"), ("<a>", "rdf"), ("", "docx")):
        with pytest.raises(readers.ParseError):
            readers.read_triples(bad, fmt)
    assert lint_graph("x") and lint_graph(TTL) is None and lint_shapes_graph("@prefix sh: <http://www.w3.org/ns/shacl#> . <x:s> sh:targetNode 1 ; sh:node <x:s> .")


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://e/a> <http://e/p> "q\\"\\\\ \\u00e9"^^<http://e/d> .\n<http://e/a> <http://e/p> "7" .\n_:b <http://e/p> _:b .\n')
    (tmp_path / "b.nt").write_text('_:b <http://e/p> "t"@EN .\n\n# note\n<http://e/a> <http://e/p> "7" .\n')
    (tmp_path / "c.ttl").write_text('<http://e/a> <http://e/p> "7" ; <http://e/q> [] .')
    g = readers.read_files(spark, [str(tmp_path / f) for f in ("a.nt", "b.nt", "c.ttl")])
    rows = g.triples().collect()
    assert len(rows) == 5 and len({r.s.lex for r in rows if r.s.kind == "bnode"}) == 2
    assert {r.o.lex for r in rows if r.o.dt == E + "d"} == {'q"\\ é'} and {r.o.num for r in rows if r.o.lex == "7"} == {7.0}
    readers.write_lines(g.triples(), str(tmp_path / "out"))
    again = readers.read_lines(spark, str(tmp_path / "out"))
    assert {(r.o.kind, r.o.lex if r.o.kind != "bnode" else "", r.o.dt, r.o.lang) for r in again.collect()} == {(r.o.kind, r.o.lex if r.o.kind != "bnode" else "", r.o.dt, r.o.lang) for r in rows}
    (tmp_path / "bad.nt").write_text("<a> <b> .\n")
    with pytest.raises(Exception, match="no triple"):
        readers.read_lines(spark, str(tmp_path / "bad.nt")).collect()


SHAPES = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <{E}> . @prefix xsd: <{XSD}> .
e:S a sh:NodeShape ; sh:targetClass e:Row ; sh:property [ sh:path e:n ; sh:minExclusive 1 ; sh:maxInclusive 3 ] ;
  sh:property [ sh:path e:name ; sh:minCount 1 ; sh:pattern "^x" ] ; sh:property [ sh:path e:ref ; sh:class e:Row ] .
"""
COLUMNS = {E + "n": Literal("n", XSD + "integer"), E + "name": Literal("name"), E + "ref": Iri(E + "row/", "ref")}


def mapping(frame):
    return Mapping(frame, Iri(E + "row/", "id"), E + "Row", COLUMNS)


def test_mapped_equals_triples(spark):
    frame = spark.createDataFrame([(1, 1, "x", 2), (2, 2, None, 9), (3, 4, "y", None), (4, None, "xx", 1)], "id int, n int, name string, ref int")
    g = MappedGraph([mapping(frame)])
    shapes = parse_shapes(readers.read_triples(SHAPES))
    out = [validate(x, shapes).rows() for x in (g, TripleGraph(g.triples()))]
    assert out[0] == out[1] and len(out[0]) == 5
    assert Dataset(g, readers.read_triples(SHAPES)).quads().where("g is null").count() == g.triples().count()


def test_stream(spark, tmp_path):
    from plumbline.streaming.rows import each_batch, validate_stream

    spark.createDataFrame([(1, 1, "x", 2), (2, 2, None, 9), (3, 4, "y", None)], "id int, n int, name string, ref int").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, n int, name string, ref int").parquet(str(tmp_path / "in"))
    shapes = parse_shapes(readers.read_triples(SHAPES.replace("sh:minCount 1 ;", "").replace("; sh:property [ sh:path e:ref ; sh:class e:Row ]", "").replace("] ;\n  sh:property [ sh:path e:ref", "] ;\n sh:property [ sh:path e:ref")))
    with pytest.raises(ValueError):
        validate_stream(mapping(source), parse_shapes(readers.read_triples(SHAPES)))
    q = validate_stream(mapping(source), shapes).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("found").count() == 3
    seen = []
    q = source.writeStream.foreachBatch(each_batch(mapping, parse_shapes(readers.read_triples(SHAPES)), lambda df, n: seen.append(df.count()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 5


def test_command_line(spark, tmp_path):
    s, d = tmp_path / "s.ttl", tmp_path / "d.ttl"
    s.write_text(SHAPES)
    d.write_text(f'@prefix e: <{E}> . e:r a e:Row ; e:n 9 ; e:name "x" .')
    out = io.StringIO()
    assert main(["parse", str(s)], out) == 0 and "NodeShape <http://e/S>" in out.getvalue()
    out = io.StringIO()
    assert main(["parse", str(s), "--output", "json"], out) == 0 and json.loads(out.getvalue())[0]["node"] == "<http://e/S>"
    out = io.StringIO()
    assert main(["info", str(s), "--detailed"], out) == 0 and "shapes: 1" in out.getvalue()
    assert main(["validate", str(s), str(d), "-o", str(tmp_path / "r.json"), "--output-format", "json"], out) == 1
    assert len(json.loads((tmp_path / "r.json").read_text())["results"]) == 1
    d.write_text(f'@prefix e: <{E}> . e:r a e:Row ; e:n 2 ; e:name "x" .')
    assert main(["validate", str(s), str(d)], out) == 0
    assert main(["parse", str(tmp_path / "none.ttl")], out) == 2


def test_tool_server(spark):
    ask = lambda method, **params: answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, lambda: spark)
    assert len(ask("tools/list")["result"]["tools"]) == 4
    call = lambda name, **a: ask("tools/call", name=name, arguments=a)["result"]
    assert call("validate_graphs_conforms", data="", shapes=SHAPES)["content"][0]["text"] == "true"
    assert "Conforms: true" in call("validate_graphs", data="", shapes=SHAPES)["content"][0]["text"]
    assert call("lint_graph", text="x")["content"][0]["text"] != "ok" and call("parse_shapes_graph")["isError"]
    assert ask("nothing")["error"]["code"] == -32601 and answer({"method": "notifications/initialized"}, None) is None


def test_store(spark, tmp_path):
    from plumbline.sources.store import load_graph, save_graph

    g = TripleGraph.of(spark, readers.read_triples(TTL))
    save_graph(g, str(tmp_path / "g"), files_each=2)
    again = load_graph(spark, str(tmp_path / "g"))
    assert {(str(r.s), r.p, str(r.o)) for r in again.triples().collect()} == {(str(r.s), r.p, str(r.o)) for r in g.triples().collect()}
    plan = again.pred(E + "p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and again.pred(E + "p").count() == 8


def test_two_columns_of_a_row(spark):
    from plumbline.operators import paths, targets
    from plumbline.plans.ir import Inverse, Predicate, Sequence, Target

    frame = spark.createDataFrame([(1, 1, "x", 2), (2, 2, None, 2), (3, 4, "y", 1), (4, 5, "z", 2), (5, 5, "z", 2)], "id int, n int, name string, ref int")
    g = MappedGraph([mapping(frame)])
    path = Sequence((Inverse(Predicate(E + "ref")), Predicate(E + "name")))
    foci = targets.resolve_target(Target("class", iri(E + "Row")), g)
    out = [sorted((r.focus.lex, r.value.lex) for r in paths.resolve(foci, path, x).collect()) for x in (g, TripleGraph(g.triples()))]
    assert g.across(E + "ref", E + "name") is not None and out[0] == out[1] == [(E + "row/1", "y"), (E + "row/2", "x"), (E + "row/2", "z")]


def test_every_format_is_written_and_read():
    a, b = iri(E + "a"), bnode("x1")
    t = [
        (a, RDF + "type", iri(E + "T")), (a, E + "p", literal('q"<&>\n\\é', lang="en-gb")), (a, E + "p", literal("5", XSD + "integer")),
        (a, E + "q-r", b), (b, "http://other/ns#z", literal(" x\t")), (b, E + "p", iri("urn:x:y")),
    ]
    plain = lambda some: sorted(tuple(str(x) if getattr(x, "kind", "") != "bnode" else "_" for x in r) for r in some)
    for fmt in ("ttl", "nt", "nq", "rdf", "jsonld", "trig"):
        assert plain(readers.read_triples(readers.to_text(t, fmt), fmt)) == plain(t), fmt
    for fmt in ("trig", "nq"):
        assert {q[3] for q in readers.quads_of(readers.to_text(t, fmt, E + "g"), fmt)} in ({iri(E + "g")}, {E + "g"})
    with pytest.raises(readers.ParseError):
        readers.to_text([(a, "http://e/9", b)], "rdf")


def test_blank_nodes_of_a_written_graph_stay_one(spark, tmp_path):
    triples = [(bnode("x"), E + "p", literal(str(i))) for i in range(30)] + [(iri(E + "a"), E + "q", bnode("x"))]
    frame = TripleGraph.of(spark, triples).triples().repartition(4)
    readers.write_lines(frame, str(tmp_path / "one"))
    readers.write_lines(frame, str(tmp_path / "two"))
    assert len(list((tmp_path / "one").glob("part-*"))) > 1
    back = readers.read_lines(spark, [str(tmp_path / "one")])
    assert back.count() == 31 and back.where("s.kind = 'bnode'").select("s").distinct().count() == 1
    both = readers.read_lines(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert both.where("s.kind = 'bnode'").select("s").distinct().count() == 2
    for i in range(3):
        (tmp_path / f"f{i}.nt").write_text(f"_:x <{E}p> _:x .\n")
    assert readers.read_lines(spark, [str(tmp_path / f"f{i}.nt") for i in range(3)]).distinct().count() == 3


def test_stream_results_are_written_by_executors(spark, tmp_path):
    """A memory sink would keep all results on the driver; its table would have no files."""
    from plumbline.queries_graph import streamed

    values = [(1, 150.0), (2, 99.0), (3, None), (4, 100.0)]
    rows = spark.createDataFrame(values, "event_id long, value double").selectExpr("event_id", "1L as user_id", "'x' as event_type", "value", "'{}' as props", "timestamp'2024-01-01' as ts")
    for k in (1, 2):
        rows.write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        out = streamed(spark, str(tmp_path))
        assert sorted(r.focus[-3:] for r in out.collect()) == ["/1>", "/4>"] and out.inputFiles(), k
    rows.limit(0).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert streamed(spark, str(tmp_path)).collect() == []
