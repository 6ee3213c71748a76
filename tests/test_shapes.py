"""Constraints, targets and paths on small graphs, with complete expected results."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline import COMPAT, Dataset, Iri, Literal, MappedGraph, Mapping, Mode, TripleGraph, register_component, validate, validate_triples
from plumbline.operators import paths, targets
from plumbline.plans.ir import Alternative, Closure, Inverse, Predicate, Sequence, Target
from plumbline.plans.shapes import ShapeError, ShapesGraph, parse_shapes
from plumbline.sources.readers import read_triples
from plumbline.sparql.parser import QueryError
from plumbline.terms import XSD, bnode, iri, literal, text_of

HEAD = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
"""
DATA = """
ex:a a ex:Person ; ex:name "Ann", "Anne"@en, "Anna"@de, "Annie"@en ; ex:age 30 ; ex:knows ex:b, ex:c ; ex:mail "ann@x.org" .
ex:b a ex:Student ; ex:name "Bo" ; ex:age "x" ; ex:knows ex:a ; ex:alias "Bo" .
ex:c a ex:Person ; ex:age 200, 5.5 ; ex:born "2001-01-01T00:00:00Z"^^xsd:dateTime ; ex:died "2000-01-01T00:00:00Z"^^xsd:dateTime ; ex:knows [ ex:age "300"^^xsd:byte ] .
ex:Student rdfs:subClassOf ex:Person . ex:likes rdfs:subPropertyOf ex:knows . ex:d ex:likes ex:a, "text" .
"""
E = "http://e/"


def graph(spark, text=DATA):
    return TripleGraph.of(spark, read_triples(HEAD + text))


def results(spark, shapes, data=DATA, mode=None):
    kw = {"mode": mode} if mode else {}
    triples = read_triples(HEAD + shapes)
    out = validate_triples(graph(spark, data), triples, **kw).rows()
    short = lambda x: x and x.replace("<http://e/", "").replace(">", "").replace("http://www.w3.org/2001/XMLSchema#", "xsd:").replace("<", "")
    return Counter((short(r["focus"]), short(r["value"]), r["component"].split("#")[-1].removesuffix("ConstraintComponent")) for r in out)


S = "ex:S a sh:NodeShape ; sh:targetClass ex:Person ; "
P = S + "sh:property [ sh:path %s ; %s ] ."
DEC = '"^^xsd:decimal'
INT = '"^^xsd:integer'
CASES = {
    "class": (P % ("ex:knows", "sh:class ex:Person"), {("c", None, "Class"): 1}),
    "datatype": (P % ("ex:age", "sh:datatype xsd:integer"), {("b", '"x"', "Datatype"): 1, ("c", '"5.5' + DEC, "Datatype"): 1}),
    "nodeKind": (P % ("ex:name", "sh:nodeKind sh:IRI"), {("a", v, "NodeKind"): 1 for v in ('"Ann"', '"Anne"@en', '"Anna"@de', '"Annie"@en')} | {("b", '"Bo"', "NodeKind"): 1}),
    "minCount": (P % ("ex:name", "sh:minCount 1"), {("c", None, "MinCount"): 1}),
    "maxCount": (P % ("ex:name", "sh:maxCount 3"), {("a", None, "MaxCount"): 1}),
    "bounds": (P % ("ex:age", "sh:minInclusive 30 ; sh:maxExclusive 200"), {("b", '"x"', "MinInclusive"): 1, ("b", '"x"', "MaxExclusive"): 1, ("c", '"5.5' + DEC, "MinInclusive"): 1, ("c", '"200' + INT, "MaxExclusive"): 1}),
    "open bounds": (P % ("ex:age", "sh:minExclusive 5.5 ; sh:maxInclusive 30"), {("b", '"x"', "MinExclusive"): 1, ("b", '"x"', "MaxInclusive"): 1, ("c", '"5.5' + DEC, "MinExclusive"): 1, ("c", '"200' + INT, "MaxInclusive"): 1}),
    "lengths": (P % ("ex:name", "sh:minLength 3 ; sh:maxLength 4"), {("b", '"Bo"', "MinLength"): 1, ("a", '"Annie"@en', "MaxLength"): 1}),
    "pattern": (P % ("ex:name", 'sh:pattern "^ann" ; sh:flags "i"'), {("b", '"Bo"', "Pattern"): 1}),
    "languageIn": (P % ("ex:name", 'sh:languageIn ( "en" )'), {("a", '"Ann"', "LanguageIn"): 1, ("a", '"Anna"@de', "LanguageIn"): 1, ("b", '"Bo"', "LanguageIn"): 1}),
    "uniqueLang": (P % ("ex:name", "sh:uniqueLang true"), {("a", None, "UniqueLang"): 1}),
    "uniqueLang off": (P % ("ex:name", "sh:uniqueLang false"), {}),
    "equals": (P % ("ex:name", "sh:equals ex:alias"), {("a", v, "Equals"): 1 for v in ('"Ann"', '"Anne"@en', '"Anna"@de', '"Annie"@en')}),
    "disjoint": (P % ("ex:name", "sh:disjoint ex:alias"), {("b", '"Bo"', "Disjoint"): 1}),
    "lessThan": (P % ("ex:born", "sh:lessThan ex:died"), {("c", '"2001-01-01T00:00:00Z"^^xsd:dateTime', "LessThan"): 1}),
    "lessThanOrEquals": (P % ("ex:age", "sh:lessThanOrEquals ex:age"), {("c", '"200' + INT, "LessThanOrEquals"): 1, ("b", None, "x"): 0}),
    "hasValue": (P % ("ex:knows", "sh:hasValue ex:a"), {("a", None, "HasValue"): 1, ("c", None, "HasValue"): 1}),
    "in": (P % ("ex:age", "sh:in ( 30 5.5 )"), {("b", '"x"', "In"): 1, ("c", '"200' + INT, "In"): 1}),
    "node": (P % ("ex:knows", "sh:node [ sh:property [ sh:path ex:mail ; sh:minCount 1 ] ]"), {("a", "b", "Node"): 1, ("a", "c", "Node"): 1, ("c", None, "Node"): 1}),
    "and": (S + "sh:and ( [ sh:property [ sh:path ex:mail ; sh:minCount 1 ] ] [ sh:class ex:Person ] ) .", {("b", "b", "And"): 1, ("c", "c", "And"): 1}),
    "or": (S + "sh:or ( [ sh:property [ sh:path ex:mail ; sh:minCount 1 ] ] [ sh:class ex:Student ] ) .", {("c", "c", "Or"): 1}),
    "xone": (S + "sh:xone ( [ sh:property [ sh:path ex:name ; sh:minCount 1 ] ] [ sh:class ex:Student ] ) .", {("b", "b", "Xone"): 1, ("c", "c", "Xone"): 1}),
    "xone twice": (S + "sh:xone ( ex:T ex:T ) . ex:T sh:class ex:Person .", {(x, x, "Xone"): 1 for x in "abc"}),
    "not": (S + "sh:not [ sh:class ex:Student ] .", {("b", "b", "Not"): 1}),
    "qualified": (P % ("ex:knows", "sh:qualifiedValueShape [ sh:class ex:Student ] ; sh:qualifiedMinCount 1"), {("b", None, "QualifiedMinCount"): 1, ("c", None, "QualifiedMinCount"): 1}),
    "qualified max": (P % ("ex:knows", "sh:qualifiedValueShape [ sh:class ex:Person ] ; sh:qualifiedMaxCount 1"), {("a", None, "QualifiedMaxCount"): 1}),
    "closed": (S.replace("ex:Person", "ex:Student") + "sh:closed true ; sh:ignoredProperties ( rdf:type ex:alias ) ; sh:property [ sh:path ex:name ] ; sh:property [ sh:path ex:knows ] .", {("b", '"x"', "Closed"): 1}),
    "nested": (P % ("ex:knows", "sh:property [ sh:path ex:age ; sh:datatype xsd:byte ]"), {("b", '"x"', "Datatype"): 1, ("c", '"200' + INT, "Datatype"): 1, ("c", '"5.5' + DEC, "Datatype"): 1, ("a", '"30' + INT, "Datatype"): 1, ("*", '"300"^^xsd:byte', "Datatype"): 1}),
    "deactivated": (S + "sh:deactivated true ; sh:class ex:Student .", {}),
}


@pytest.mark.parametrize("name", CASES)
def test_constraint(spark, name):
    shapes, want = CASES[name]
    got = results(spark, shapes)
    blank = lambda k: tuple(None if x and x.startswith("_:") else x for x in k)
    if name == "nested":
        want = {tuple(None if x == "*" else x for x in k): n for k, n in want.items()}
    assert Counter({blank(k): n for k, n in got.items()}) == Counter({k: n for k, n in want.items() if n})


def test_sibling_shapes(spark):
    data = """ex:orchard ex:tree ex:t1, ex:t2, ex:t3, ex:t4, ex:t5 . ex:t1 ex:age 40 ; ex:bears "plum" . ex:t2 ex:age 70 . ex:t3 ex:bears "plum" .
    ex:t4 ex:age 55 . ex:t5 ex:bears "fig" ."""
    q = "sh:property [ sh:path ex:tree ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedValueShape [ %s ] ; sh:qualifiedMinCount %d ; sh:qualifiedMaxCount %d ] ; "
    old, plums = "sh:property [ sh:path ex:age ; sh:minInclusive 30 ; sh:minCount 1 ]", 'sh:property [ sh:path ex:bears ; sh:hasValue "plum" ]'
    # t1 is both and counts for neither: two old trees, one plum tree
    shapes = "ex:S a sh:NodeShape ; sh:targetNode ex:orchard ; " + q % (old, 3, 3) + q % (plums, 1, 0) + "."
    assert results(spark, shapes, data) == {("orchard", None, "QualifiedMinCount"): 1, ("orchard", None, "QualifiedMaxCount"): 1}


def test_details_explain_results(spark):
    shapes = """ex:S a sh:NodeShape ; sh:targetClass ex:Person ; sh:node ex:In .
    ex:In sh:property ex:Know . ex:Know sh:path ex:knows ; sh:and ( ex:Mail ) . ex:Mail sh:property ex:MailP . ex:MailP sh:path ex:mail ; sh:minCount 1 ."""
    report = validate_triples(graph(spark), read_triples(HEAD + shapes), details=True)
    plain = validate_triples(graph(spark), read_triples(HEAD + shapes))
    assert report.rows() == plain.rows() and report.rows() and plain.details().count() == 0
    details = report.details().collect()
    assert {r.parent_component.split("#")[1] for r in details} == {"NodeConstraintComponent", "AndConstraintComponent"}
    parents = {(r["source_shape"], r["component"], r["value"]) for r in report.rows()} | {(r.source_shape, r.component, r.value) for r in details}
    assert all((r.parent_shape, r.parent_component, r.parent_value) in parents for r in details)
    nested = json.loads(report.to_json())
    assert len(nested["results"]) == len(report.rows())
    assert all(d["sourceConstraintComponent"].endswith("AndConstraintComponent") and d["details"] for r in nested["results"] for d in r["details"])
    triples = read_triples(report.render("ttl"))
    assert sum(p.endswith("#detail") for _, p, _ in triples) >= 2 * len(report.rows())
    assert sum(p.endswith("#result") for _, p, _ in triples) == len(report.rows())


def test_reports_by_executors(spark, tmp_path):
    path = "[ sh:alternativePath ( ex:knows [ sh:inversePath ex:knows ] ) ]"
    shapes = f'ex:S a sh:NodeShape ; sh:targetClass ex:Person ; sh:message "a \\"b\\"" ; sh:property [ sh:path {path} ; sh:minCount 99 ; sh:nodeKind sh:Literal ] ; sh:nodeKind sh:Literal .'
    report = validate_triples(graph(spark), read_triples(HEAD + shapes))
    report.write(str(tmp_path / "nt"), "nt")
    report.write(str(tmp_path / "json"), "json")
    read = lambda f: "".join(p.read_text() for p in sorted((tmp_path / f).glob("part-*")))
    triples, whole = read_triples(read("nt"), "nt"), report.to_triples()
    assert not Counter(p for _, p, _ in triples) - Counter(p for _, p, _ in whole)
    plain = lambda some: Counter((p, str(o)) for _, p, o in some if o.kind != "bnode" and not p.endswith(("first", "rest", "Path")))
    assert plain(triples) == plain(whole)
    assert {ShapesGraph(triples).path(o) for _, p, o in triples if p.endswith("#resultPath")} == {ShapesGraph(whole).path(o) for _, p, o in whole if p.endswith("#resultPath")}
    assert len(read("json").splitlines()) == len(report.rows())


def test_result_paths_and_sources_as_rdf(spark):
    path = "( ex:knows [ sh:inversePath ex:knows ] [ sh:alternativePath ( ex:name [ sh:zeroOrMorePath ex:knows ] ) ] [ sh:oneOrMorePath ex:a ] [ sh:zeroOrOnePath ex:b ] )"
    shapes = f"ex:S a sh:NodeShape ; sh:targetClass ex:Person ; sh:property [ sh:path {path} ; sh:minCount 99 ] ; sh:sparql ex:Q . ex:Q sh:select \"SELECT $this WHERE {{ $this a ?c }}\" ."
    out = read_triples(validate_triples(graph(spark), read_triples(HEAD + shapes)).render("nt"), "nt")
    again = ShapesGraph(out)
    nodes = {o for _, p, o in out if p.endswith("#resultPath")}
    want = ShapesGraph(read_triples(HEAD + shapes)).shape(iri(E + "S")).properties[0].path
    assert {again.path(n) for n in nodes} == {want}
    assert {o for _, p, o in out if p.endswith("#sourceConstraint")} == {iri(E + "Q")}


def test_compat_differs(spark):
    one = lambda shapes, data: results(spark, shapes, data, COMPAT)
    assert one(P % ("ex:knows", "sh:class ex:Person"), DATA)[("a", "b", "Class")] == 1
    assert one("ex:S sh:targetNode ex:s ; sh:property [ sh:path ex:p ; sh:maxLength 1 ] .", 'ex:s ex:p "é" .') == {("s", '"é"', "MaxLength"): 1}
    less = "ex:S sh:targetNode ex:s ; sh:property [ sh:path ex:p ; sh:lessThan ex:q ] ."
    assert one(less, "ex:s ex:p 2 ; ex:q 1, 3 .") == {}
    assert results(spark, less, "ex:s ex:p 2 ; ex:q 1, 3 .") == {("s", '"2"^^xsd:integer', "LessThan"): 1}
    assert one(P % ("ex:name", "sh:uniqueLang false"), DATA) == {("a", '"Annie"@en', "UniqueLang"): 1}
    assert one("ex:S sh:targetNode ex:s ; sh:property [ sh:path ex:p ; sh:minInclusive 5 ] .", 'ex:s ex:p "7" .') == {}
    assert sum(results(spark, "ex:S sh:targetNode ex:s ; sh:property [ sh:path ex:p ; sh:minInclusive 5 ] .", 'ex:s ex:p "7" .').values()) == 1
    assert Mode(cycle_back=False).cycle_back is False


def test_severity_messages_and_names(spark):
    shapes = S + 'sh:name "N" ; sh:severity sh:Warning ; sh:message "own" ; sh:property [ sh:path ex:mail ; sh:minCount 1 ; sh:severity ex:Odd ; sh:message "mail" ] ; sh:class ex:Student .'
    report = validate_triples(graph(spark), read_triples(HEAD + shapes))
    rows = report.rows()
    assert {(r["severity"].split("#")[-1].split("/")[-1], "own" in r["messages"], "mail" in r["messages"]) for r in rows} == {("Warning", True, False), ("Odd", False, True)}
    assert {r["source_shape_name"] for r in rows} == {"N", ""}
    assert not report.conforms and {r.severity.split("#")[-1]: r.n for r in report.by_severity().collect()}["Warning"] == 2
    assert '"conforms": false' in report.to_json() and "Warning: 2" in report.to_text()
    again = read_triples(report.render("ttl"))
    assert sum(p.endswith("#focusNode") for _, p, _ in again) == len(rows)
    assert len(read_triples(report.render("jsonld"), "jsonld")) == len(again)


def test_targets(spark):
    g = graph(spark)
    nodes = lambda kind, name, **kw: {str(r.focus.lex).removeprefix(E) for r in targets.resolve_target(Target(kind, iri(E + name)), g, **kw).collect()}
    assert nodes("class", "Person") == {"a", "b", "c"} and nodes("class", "Student") == {"b"}
    assert nodes("subjects", "knows") == {"a", "b", "c", "d"} and nodes("subjects", "likes") == {"d"}
    assert len(nodes("objects", "knows")) == 4 and nodes("objects", "name") == set()
    assert nodes("objects", "likes", literals=True) == {"a", "text"}
    assert nodes("node", "nowhere") == {"nowhere"} and nodes("advanced", "x") == set()
    both = results(spark, "ex:Person a rdfs:Class, sh:NodeShape ; sh:targetNode ex:a ; sh:nodeKind sh:Literal .")
    assert both == {(x, x, "NodeKind"): 1 for x in "abc"}


KNOWS, PARENT = Predicate(E + "knows"), Predicate(E + "parent")


def naive(path, node, triples):
    """Values of a path from one node, by recursion."""
    if isinstance(path, Predicate):
        return {o for s, p, o in triples if s == node and p == path.iri}
    if isinstance(path, Inverse):
        return {x for x in {t for s, _, o in triples for t in (s, o)} if node in naive(path.path, x, triples)}
    if isinstance(path, Sequence):
        now = {node}
        for p in path.parts:
            now = set().union(*(naive(p, x, triples) for x in now), set())
        return now
    if isinstance(path, Alternative):
        return set().union(*(naive(p, node, triples) for p in path.parts))
    if not path.many:
        return {node} | naive(path.path, node, triples)
    found, todo = set(), [node]
    while todo:
        for x in naive(path.path, todo.pop(), triples):
            if x not in found:
                found.add(x)
                todo.append(x)
    return found | ({node} if path.least == 0 else set())


PATHS = [
    KNOWS,
    Inverse(KNOWS),
    Sequence((KNOWS, KNOWS)),
    Alternative((KNOWS, Inverse(PARENT))),
    Closure(KNOWS, 0),
    Closure(KNOWS, 1),
    Closure(KNOWS, 0, False),
    Closure(Sequence((KNOWS, Inverse(PARENT))), 1),
    Inverse(Sequence((KNOWS, PARENT))),
    Sequence((Closure(Alternative((KNOWS, PARENT)), 0), PARENT)),
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("path", PATHS, ids=str)
def test_paths_against_recursion(spark, path, seed):
    import random

    rng = random.Random(seed)
    nodes = [iri(f"{E}{k}") for k in range(7)] + [bnode("x")]
    triples = list({(rng.choice(nodes), rng.choice([KNOWS, PARENT]).iri, rng.choice([*nodes, literal("t")])) for _ in range(14)})
    g = TripleGraph.of(spark, triples)
    foci = targets.constants(g, nodes)
    got = {(r.focus.lex, r.value.kind, r.value.lex) for r in paths.resolve(foci, path, g).collect()}
    assert got == {(n.lex, v.kind, v.lex) for n in nodes for v in naive(path, n, triples)}


def test_cycle_without_start(spark):
    g = graph(spark, "ex:a ex:knows ex:b . ex:b ex:knows ex:a .")
    foci = targets.constants(g, [iri(E + "a")])
    values = lambda **kw: {r.value.lex for r in paths.resolve(foci, Closure(KNOWS, 1), g, **kw).collect()}
    assert values() == {E + "a", E + "b"} and values(cycle_back=False) == {E + "b"}


def test_ill_formed_shapes():
    bad = [
        "ex:S a sh:NodeShape ; sh:node ex:S .",
        "ex:S a sh:NodeShape ; sh:property ex:P . ex:P sh:path ex:p ; sh:node ex:S .",
        "ex:S a sh:PropertyShape ; sh:path [ ex:nothing 1 ] .",
        "ex:S a sh:NodeShape ; sh:in ex:L . ex:L rdf:first 1 ; rdf:rest ex:L .",
        "ex:S a sh:NodeShape ; sh:and ex:L . ex:L rdf:first ex:T .",
    ]
    for text in bad:
        with pytest.raises(ShapeError):
            parse_shapes(read_triples(HEAD + text))
        assert parse_shapes(read_triples(HEAD + text), COMPAT) == []
    shape = parse_shapes(read_triples(HEAD + S + "sh:property [ sh:path ( ex:p [ sh:inversePath ex:q ] ) ; sh:minCount 1 ] ."))[0]
    assert str(shape.properties[0].path) == "<http://e/p>/^<http://e/q>"
    assert shape.counts() == {"targets": 1, "constraints": 1, "properties": 1} and "MinCount[minCount=1]" in str(shape)


# SPARQL -----------------------------------------------------------------------------------------------------------
SPARQL = 'ex:P sh:declare [ sh:prefix "ex" ; sh:namespace "http://e/" ] . ' + S + 'sh:sparql [ sh:prefixes ex:P ; sh:message "{?value} of {$this}" ; sh:select """%s""" ] .'


def test_sparql_constraint(spark):
    assert results(spark, SPARQL % "SELECT $this ?value WHERE { $this ex:age ?value . FILTER(!isNumeric(?value) || ?value > 100) }") == {("b", '"x"', "SPARQL"): 1, ("c", '"200"^^xsd:integer', "SPARQL"): 1}
    assert results(spark, SPARQL % "SELECT $this WHERE { FILTER NOT EXISTS { $this ex:mail ?m } }") == {("b", "b", "SPARQL"): 1, ("c", "c", "SPARQL"): 1}
    assert results(spark, SPARQL % "SELECT $this WHERE { { FILTER(bound($this)) $this a ex:Student } UNION { $this ex:mail ?m } }") == {("b", "b", "SPARQL"): 1, ("a", "a", "SPARQL"): 1}
    report = validate_triples(graph(spark), read_triples(HEAD + SPARQL % "SELECT $this ?value WHERE { $this ex:mail ?value }"))
    assert report.rows()[0]["messages"] == ["ann@x.org of http://e/a"]
    for bad in ("SELECT $this WHERE { $this ?p ?o MINUS { $this ex:mail ?o } }", "SELECT $this WHERE { BIND(1 AS ?this) }", "SELECT $this WHERE { SERVICE ex:x { $this ?p ?o } }", "SELECT"):
        with pytest.raises(QueryError):
            results(spark, SPARQL % bad)


def test_sparql_component(spark):
    shapes = """ex:P sh:declare [ sh:prefix "ex" ; sh:namespace "http://e/" ] .
    ex:Starts a sh:ConstraintComponent ; sh:parameter [ sh:path ex:start ], [ sh:path ex:unused ; sh:optional true ] ;
      sh:validator [ sh:ask "ASK { FILTER(STRSTARTS(STR($value), $start)) }" ; sh:message "no {$start}" ] .
    ex:S a sh:NodeShape ; sh:targetClass ex:Person ; sh:property [ sh:path ex:name ; ex:start "An" ] ."""
    out = validate_triples(graph(spark), read_triples(HEAD + shapes)).rows()
    assert [(r["focus"], r["value"], r["component"], r["messages"]) for r in out] == [("<http://e/b>", '"Bo"', "http://e/Starts", ["no An"])]


def test_registered_component(spark):
    from pyspark.sql import functions as F

    from plumbline.plans.ir import Constraint, Shape

    register_component("http://e/Odd", lambda k, shape, c, foci, vals, home: vals.where("value.num % 2 = 1").withColumn("message", F.lit("odd")))
    shape = Shape(iri(E + "S"), Predicate(E + "age"), targets=(Target("node", iri(E + "x")),), constraints=(Constraint("http://e/Odd"),))
    rows = validate(Dataset(graph(spark, "ex:x ex:age 3, 4 .")), [shape]).rows()
    assert [(r["value"], r["messages"]) for r in rows] == [('"3"^^<http://www.w3.org/2001/XMLSchema#integer>', ["odd"])]


def ask(spark, text, data=DATA):
    from plumbline.sparql.evaluate import run_query

    out = run_query(Dataset(graph(spark, data)), text, {"ex": E, "xsd": "http://www.w3.org/2001/XMLSchema#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"})
    return sorted(tuple(None if v is None else v if isinstance(v, bool) else v.lex.removeprefix(E) for v in r) for r in out.collect())


def test_sparql_queries(spark):
    assert ask(spark, "SELECT ?x WHERE { ?x a/rdfs:subClassOf* ex:Person }") == [("a",), ("b",), ("c",)]
    assert ask(spark, "SELECT ?x ?m WHERE { ?x a ex:Person OPTIONAL { ?x ex:mail ?m } }") == [("a", "ann@x.org"), ("c", None)]
    assert ask(spark, "SELECT ?x (COUNT(?n) AS ?k) WHERE { ?x ex:name ?n } GROUP BY ?x HAVING(COUNT(?n) > 1)") == [("a", "4")]
    assert ask(spark, "SELECT (SUM(?n) AS ?s) (GROUP_CONCAT(DISTINCT ?l; separator=',') AS ?g) WHERE { ?x ex:age ?n BIND(STRLEN(STR(?x)) AS ?l) FILTER(isNumeric(?n)) FILTER(isIRI(?x)) }") == [("235.5", "10")]
    assert ask(spark, "SELECT ?n WHERE { ex:a ex:name ?n FILTER(langMatches(LANG(?n), 'EN')) } ORDER BY DESC(?n) LIMIT 1") == [("Annie",)]
    assert ask(spark, "SELECT ?x ?v WHERE { VALUES (?x ?v) { (ex:a 1) (ex:zz UNDEF) } ?x ex:mail ?m }") == [("a", "1")]
    assert ask(spark, "SELECT DISTINCT ?p WHERE { ex:a ?p ?o FILTER(?o IN (30, ex:b)) }") == [("age",), ("knows",)]
    assert ask(spark, "SELECT ?v WHERE { ex:a ex:age ?n BIND(IF(?n > 20, COALESCE(?zz, UCASE('old')), 'young') AS ?v) }") == [("OLD",)]
    assert ask(spark, "SELECT ?y WHERE { ex:a !(ex:knows|ex:name) ?y FILTER(isIRI(?y)) }") == [("Person",)]
    assert ask(spark, "SELECT ?y WHERE { ?y ^ex:knows ex:b }") == [("a",)]
    assert ask(spark, "SELECT ?v WHERE { ex:a ex:age ?n BIND((?n + 2) * 2 / 4 - 1 AS ?v) }") == [("15",)]
    assert ask(spark, "ASK { ?x ex:mail ?m FILTER(REGEX(?m, '^ANN', 'i') && STRAFTER(?m, '@') = 'x.org') }") == [(True,)]
    assert ask(spark, "ASK { ex:a ex:mail ?m FILTER(?m / 2 > 1) }") == [(False,)]


@pytest.mark.parametrize("starts", [0, 1000])
def test_closures_by_walking(spark, starts, monkeypatch):
    """Both ways to close a path, on a graph with circles, long ways and literals at their ends."""
    monkeypatch.setattr(paths, "STARTS", starts)
    rng = random.Random(4)
    edges = {(i, i + 1) for i in range(20)} | {(rng.randrange(30), rng.randrange(30)) for _ in range(15)}
    some = [(iri(f"{E}n{a}"), E + "p", iri(f"{E}n{b}")) for a, b in edges] + [(iri(f"{E}n{a}"), E + "p", literal(f"x{a}")) for a in (3, 25)]
    g = TripleGraph.of(spark, some)
    after = lambda a: {str(o) for s, _, o in some if str(s) == a}

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            new = after(todo.pop()) - seen
            seen |= new
            todo += new
        return seen

    foci = targets.resolve_target(Target("subjects", iri(E + "p")), g)
    for least in (0, 1):
        out = paths.resolve(foci, Closure(Predicate(E + "p"), least), g).select(text_of(F.col("focus")).alias("f"), text_of(F.col("value")).alias("v")).collect()
        want = {(a, b) for a in {str(s) for s, _, _ in some} for b in reached(a) | ({a} if least == 0 else set())}
        assert Counter((r.f, r.v) for r in out) == Counter(want)


@pytest.mark.parametrize(
    ("tests", "apart"),
    [
        ("sh:or ( ex:Low ex:Paid )", True),
        ("sh:and ( ex:Paid ex:Low ) ; sh:node ex:Big ; sh:property [ sh:path ex:by ; sh:minCount 1 ]", True),
        ("sh:and ( ex:Low ex:F ) ; sh:and ( ex:Low ex:Big )", False),
        ("sh:xone ( ex:F ex:Big ) ; sh:not ex:Low", True),
    ],
)
def test_details_of_rows_need_no_shuffle(spark, tests, apart):
    shapes = f"""ex:S a sh:NodeShape ; sh:targetClass ex:Order ; {tests} .
    ex:Low sh:property ex:LowP . ex:LowP sh:path ex:total ; sh:maxInclusive 3 . ex:Paid sh:and ( ex:F ex:Big ) .
    ex:F sh:property ex:FP . ex:FP sh:path ex:status ; sh:hasValue "F" . ex:Big sh:property ex:BigP . ex:BigP sh:path ex:total ; sh:minInclusive 4 ."""
    orders = spark.createDataFrame([(1, 7, "P", 2.0), (2, None, "F", 3.5), (3, 8, None, 5.0), (4, 7, "F", 1.0), (5, 8, "F", 9.0), (6, 8, "P", None)], "k int, c int, s string, t double")
    made = {E + "by": Iri(E + "c/", "c"), E + "status": Literal("s"), E + "total": Literal("t", XSD + "double")}
    mapped = MappedGraph([Mapping(orders, Iri(E + "o/", "k"), E + "Order", made)])
    found = validate_triples(mapped, read_triples(HEAD + shapes), details=True)
    stored = validate_triples(TripleGraph(mapped.triples()), read_triples(HEAD + shapes), details=True)
    assert found.rows() == stored.rows()
    details = found.details()
    assert Counter(map(str, details.collect())) == Counter(map(str, stored.details().select(*details.columns).collect())) and not details.isEmpty()
    plan = details._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and ("Aggregate" in plan) != apart
