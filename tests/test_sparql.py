"""SPARQL groups and query forms against solutions worked out by hand."""

from collections import Counter

import pytest

from plumbline.api import validate_triples
from plumbline.graph import Dataset, Iri, Literal, MappedGraph, Mapping, TripleGraph
from plumbline.sources.readers import read_triples
from plumbline.sparql.evaluate import run_query
from plumbline.sparql.parser import QueryError
from plumbline.terms import iri, literal

E = "http://e/"
PREFIXES = {"": E, "xsd": "http://www.w3.org/2001/XMLSchema#"}
HEAD = f"@prefix : <{E}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <{PREFIXES['xsd']}> .\n"
PEOPLE = """:a :t 1 ; :m "y" . :b :t 1 ; :n "x" ; :m "z" . :c :t 2 ; :n "w" ; :likes :a, :b . :b :likes :a .
:d :at "2020-02-03T04:05:06+05:30"^^xsd:dateTime ."""


def graph(spark, data):
    return TripleGraph.of(spark, read_triples(HEAD + data))


@pytest.fixture
def ask(spark):
    def run(query, data=PEOPLE):
        out = run_query(Dataset(graph(spark, data)), query, PREFIXES)
        names = out.columns
        short = lambda t: None if t is None else t["lex"].replace(E, "")
        return Counter(tuple(short(r[n]) for n in names) for r in out.collect())

    return run


def rows(*some):
    return Counter(x if isinstance(x, tuple) else (x,) for x in some)


CASES = {
    # an option after an option: what the first left unbound matches all
    "SELECT ?s ?v { ?s :t 1 OPTIONAL { ?s :n ?v } OPTIONAL { ?s :m ?v } }": rows(("a", "y"), ("b", "x")),
    "SELECT ?s ?v ?w { ?s :t 1 OPTIONAL { ?s :n ?v } OPTIONAL { ?s :m ?w FILTER(?w != \"y\") } }": rows(("a", None, None), ("b", "x", "z")),
    "SELECT ?s ?v { ?s :t 1 OPTIONAL { ?s :n ?v } ?x :n ?v }": rows(("a", "x"), ("a", "w"), ("b", "x")),
    "SELECT ?s ?v { ?s :t ?k OPTIONAL { ?s :n ?v } VALUES ?v { \"x\" } }": rows(("a", "x"), ("b", "x")),
    "SELECT ?s ?v { ?s :t 1 OPTIONAL { ?s :n ?v FILTER EXISTS { ?o :likes ?s } } }": rows(("a", None), ("b", "x")),
    "SELECT ?s ?v { ?s :t 2 OPTIONAL { ?s :likes* ?v } }": rows(("c", "c"), ("c", "a"), ("c", "b")),
    # the filter of an option sees the variables outside it
    "SELECT ?s ?o { ?s :t ?k OPTIONAL { ?s :likes ?o . ?o :t ?j FILTER(?j < ?k) } }": rows(("a", None), ("b", None), ("c", "a"), ("c", "b")),
    "SELECT ?s { ?s :t ?k FILTER EXISTS { ?s :likes ?o . ?o :t ?j FILTER(?j = ?k) } }": rows("b"),
    "SELECT ?s { ?s :t ?k FILTER NOT EXISTS { ?o :likes ?s } }": rows("c"),
    "SELECT ?s { ?s :t ?k FILTER(?k = 2 || EXISTS { ?s :likes :a }) }": rows("b", "c"),
    "SELECT ?s { ?s :t ?k FILTER(!(?k = 2 || EXISTS { ?s :likes :a })) }": rows("a"),
    "SELECT ?s { ?s :t ?k MINUS { ?s :n ?v } }": rows("a"),
    "SELECT ?s { ?s :t ?k MINUS { ?x :n ?v } }": rows("a", "b", "c"),
    # aggregates of nothing, and of groups
    "SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?m) (MIN(?x) AS ?l) { :z :t ?x }": rows(("0", "0", None)),
    "SELECT (COUNT(?x) AS ?n) { :z :t ?x } HAVING (COUNT(?x) > 0)": rows(),
    "SELECT ?k (COUNT(?s) + 1 AS ?n) { ?s :t ?k } GROUP BY ?k": rows(("1", "3"), ("2", "2")),
    "SELECT ?k { ?s :t ?k } GROUP BY ?k HAVING (COUNT(?s) > 1)": rows("1"),
    "SELECT ?k { :z :t ?k } GROUP BY ?k": rows(),
    # nested queries are evaluated by themselves, lateral ones for each solution
    "SELECT ?s ?o { ?s :t ?k { SELECT ?s ?o { ?s :likes ?o } ORDER BY ?s ?o LIMIT 1 } }": rows(("b", "a")),
    "SELECT ?s ?o { ?s :t ?k LATERAL { SELECT ?s ?o { ?s :likes ?o } ORDER BY DESC(?o) LIMIT 1 } }": rows(("b", "a"), ("c", "b")),
    "SELECT ?s ?n { ?s :t ?k LATERAL { SELECT ?s (COUNT(?o) AS ?n) { ?s :likes ?o } } }": rows(("a", "0"), ("b", "1"), ("c", "2")),
    "SELECT DISTINCT ?k { ?s :t ?k } ORDER BY DESC(?k) LIMIT 1": rows("2"),
    "SELECT ?s ?o { ?s :likes+ ?o }": rows(("b", "a"), ("c", "a"), ("c", "b")),
    "SELECT ?o { :c :likes/:t ?o }": rows("1", "1"),
    "SELECT ?s { { ?s :n \"x\" } UNION { ?s :n \"w\" } ?s :likes ?o } VALUES ?o { :a }": rows("b", "c"),
    "SELECT ?s ?v { VALUES (?s ?v) { (:a UNDEF) (:b \"z\") } ?s :m ?v }": rows(("a", "y"), ("b", "z")),
    "SELECT (TZ(?x) AS ?a) (TIMEZONE(?x) AS ?b) (SHA512(\"\") AS ?c) { :d :at ?x }": rows(
        ("+05:30", "PT5H30M", "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e")
    ),
    "SELECT (ISIRI(UUID()) && STRLEN(STRUUID()) = 36 && RAND() < 1 && YEAR(NOW()) > 2000 AS ?x) { }": rows("true"),
    "SELECT ?s ?p { ?s ?p :a }": rows(("c", "likes"), ("b", "likes")),
    "SELECT ?g { GRAPH ?g { ?s ?p ?o } }": rows(),
}


@pytest.mark.parametrize("query", CASES)
def test_solutions(ask, query):
    assert ask(query) == CASES[query]


def test_construct_and_describe(spark):
    data = Dataset(graph(spark, PEOPLE))
    show = lambda q: {(r.s.lex.replace(E, ""), r.p.replace(E, ""), r.o.lex.replace(E, "")) for r in run_query(data, q, PREFIXES).collect()}
    assert show("CONSTRUCT { ?o :liked ?s . ?s :k ?v } WHERE { ?s :likes ?o OPTIONAL { ?o :n ?v } }") == {
        ("a", "liked", "c"), ("a", "liked", "b"), ("b", "liked", "c"), ("c", "k", "x"),
    }
    assert show("CONSTRUCT WHERE { ?s :n ?v }") == {("b", "n", "x"), ("c", "n", "w")}
    made = run_query(data, "CONSTRUCT { _:x :of ?s ; :t ?k } WHERE { ?s :t ?k }", PREFIXES).collect()
    assert len(made) == 6 and len({r.s.lex for r in made}) == 3 and {r.s.kind for r in made} == {"bnode"}
    assert show("DESCRIBE :a ?s { ?s :n \"x\" }") == {("a", "t", "1"), ("a", "m", "y"), ("b", "t", "1"), ("b", "n", "x"), ("b", "m", "z"), ("b", "likes", "a")}
    assert run_query(data, "ASK { :a :t 2 }", PREFIXES).first().ask is False


SHAPE = HEAD + ':P sh:declare [ sh:prefix "" ; sh:namespace "http://e/" ] . :S sh:targetSubjectsOf :in ; sh:sparql [ sh:prefixes :P ; sh:select """%s""" ] .'
MANY = ":a :in :x ; :p 1, 2, 3 . :b :in :x ; :p 3 . :c :in :x ."


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT $this ?value WHERE { $this :p ?value } ORDER BY DESC(?value) LIMIT 1", [("a", "3"), ("b", "3")]),
        ("SELECT $this ?value WHERE { $this :p ?value } ORDER BY ?value OFFSET 1", [("a", "2"), ("a", "3")]),
        ("SELECT $this ?value WHERE { { SELECT $this ?value WHERE { $this :p ?value } ORDER BY ?value LIMIT 1 } }", [("a", "1"), ("b", "3")]),
        ("SELECT $this (COUNT(?x) AS ?value) WHERE { $this :p ?x } HAVING (COUNT(?x) = 0)", [("c", "0")]),
        ("SELECT $this WHERE { OPTIONAL { $this :p ?x } FILTER(!BOUND(?x)) }", [("c", None)]),
        ("SELECT $this ?value WHERE { $this :in ?i OPTIONAL { ?value :p 1 } FILTER(?value = $this) }", [("a", "a")]),
        ("SELECT $this WHERE { FILTER NOT EXISTS { $this :p ?x FILTER(?x < 3) } }", [("b", None), ("c", None)]),
    ],
)
def test_constraints_ask_for_each_focus(spark, query, want):
    report = validate_triples(graph(spark, MANY), read_triples(SHAPE % query))
    clean = lambda t: None if t is None else t.split("^^")[0].strip('"<>').replace(E, "")
    got = sorted((clean(r["focus"]), clean(r["value"])) for r in report.rows())
    assert got == sorted((f, f if v is None else v) for f, v in want)


@pytest.mark.parametrize("part", ["MINUS { $this :p 1 }", "SERVICE <http://s/> { ?a ?b ?c }", "VALUES ?x { 1 }"])
def test_constraints_refuse(spark, part):
    with pytest.raises(QueryError):
        validate_triples(graph(spark, MANY), read_triples(SHAPE % f"SELECT $this WHERE {{ $this :in ?i {part} }}"))


STARS = [
    ('SELECT ?p (COUNT(?o) AS ?n) WHERE { ?o :status "P" ; ?p ?v } GROUP BY ?p', True),
    ("SELECT * WHERE { ?o :total ?t ; ?p ?t ; a ?c ; ?q ?x }", True),
    ("SELECT * WHERE { ?o :by ?c ; :status ?s . ?c :name ?x ; ?p ?v }", False),
    ("SELECT ?o WHERE { ?o :status ?s ; :name ?x }", False),
    ('SELECT * WHERE { ?o :status "P" ; a ?k OPTIONAL { ?o :by ?c ; :total ?t FILTER(?t > 1) } }', False),
]


@pytest.mark.parametrize(("query", "joinless"), STARS)
def test_triples_of_one_row_need_no_join(spark, query, joinless):
    orders = spark.createDataFrame([(1, 7, "P", 2.0), (2, 7, None, 3.0), (3, 8, "P", None), (4, None, "F", 1.0), (None, 7, "P", 5.0)], "k int, c int, s string, t double")
    people = spark.createDataFrame([(7, "x"), (8, None), (9, "P")], "k int, n string")
    made = {E + "by": Iri(E + "c/", "c"), E + "status": Literal("s"), E + "total": Literal("t", PREFIXES["xsd"] + "double")}
    tables = [Mapping(orders, Iri(E + "o/", "k"), E + "Order", made), Mapping(people, Iri(E + "c/", "k"), E + "Person", {E + "name": Literal("n")})]
    for extra in ((), [(iri(E + "o/3"), E + "total", literal("9", PREFIXES["xsd"] + "double"))]):
        mapped = MappedGraph(tables, extra)
        stored = TripleGraph(mapped.triples().where("s.lex is not null and o.lex is not null"))
        found = run_query(Dataset(mapped), query, PREFIXES)
        counts = lambda x: Counter(tuple(None if r[n] is None else r[n]["lex"] for n in sorted(x.columns)) for r in x.collect())
        assert counts(found) == counts(run_query(Dataset(stored), query, PREFIXES))
        joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join")
        if joinless and not extra:
            assert joins == 1  # with the row that a query starts from
