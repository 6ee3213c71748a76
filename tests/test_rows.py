"""Plans on rows of tables against the same shapes over the same triples, stored one by one."""

import random
from collections import Counter

import pytest

from plumbline.api import validate_triples
from plumbline.graph import Iri, Literal, MappedGraph, Mapping, TripleGraph
from plumbline.plans.mode import COMPAT, STRICT
from plumbline.sources.readers import read_triples
from plumbline.terms import XSD, Term, iri, literal

E = "http://e/"
HEAD = f"@prefix ex: <{E}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <{XSD}> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
S = "ex:S a sh:NodeShape ; sh:targetClass ex:Boat ; "
DEAR, RED = "[ sh:property [ sh:path ex:price ; sh:minExclusive 50 ; sh:minCount 1 ] ]", '[ sh:property [ sh:path ex:colour ; sh:hasValue "red" ] ]'
LEGS = "[ sh:inversePath ex:boat ]"
SHAPES = [
    S + "sh:property [ sh:path ex:price ; sh:minInclusive 10 ; sh:maxCount 1 ; sh:minCount 1 ] .",
    S + f"sh:and ( {DEAR} {RED} ) .",
    S + f"sh:or ( {DEAR} {RED} [ sh:nodeKind sh:Literal ] ) .",
    S + f"sh:xone ( {DEAR} {RED} {RED} ) .",
    S + f"sh:not [ sh:or ( {DEAR} [ sh:not {RED} ] ) ] .",
    S + f"sh:node {DEAR} ; sh:pattern \"[13579]$\" .",
    S + f"sh:property [ sh:path {LEGS} ; sh:minCount 1 ; sh:maxCount 3 ] .",
    S + f"sh:property [ sh:path ( {LEGS} ex:miles ) ; sh:hasValue 7 ] .",
    S + f"sh:property [ sh:path {LEGS} ; sh:qualifiedValueShape [ sh:property [ sh:path ex:miles ; sh:minInclusive 6 ] ] ; sh:qualifiedMinCount 1 ; sh:qualifiedMaxCount 2 ] .",
    S + f"sh:property [ sh:path {LEGS} ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShape [ sh:property [ sh:path ex:miles ; sh:minInclusive 6 ] ] ] ;"
    f" sh:property [ sh:path {LEGS} ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShape [ sh:property [ sh:path ex:crew ; sh:maxExclusive 5 ] ] ] .",
    S + "sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path ex:price ] .",
    "ex:S sh:targetClass ex:Leg ; sh:property [ sh:path ex:boat ; sh:node " + DEAR + " ] .",
    "ex:S sh:targetClass ex:Leg ; sh:property [ sh:path ex:boat ; sh:or ( " + DEAR + " " + RED + " ) ; sh:not " + RED + " ] .",
    "ex:S sh:targetClass ex:Leg ; sh:property [ sh:path ( ex:boat ex:price ) ; sh:maxInclusive 60 ; sh:minCount 1 ; sh:lessThan ex:miles ] .",
    "ex:S sh:targetClass ex:Leg ; sh:property [ sh:path ex:miles ; sh:lessThanOrEquals ex:crew ; sh:datatype xsd:integer ] .",
    "ex:S sh:targetClass ex:Leg ; sh:property [ sh:path ( ex:boat ex:colour ) ; sh:in ( \"red\" ) ; sh:equals ( ex:boat ex:colour ) ] .",
]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    boats = [(i, rng.choice([None, 5.0, 49.0, 50.0, 80.0]), rng.choice([None, "red", "blue"])) for i in range(12)]
    # some legs have no boat, and some boats that legs have aren't in the table
    legs = [(f"l{i}", rng.choice([None, *range(15)]), rng.choice([None, 1, 6, 7, 70]), rng.choice([None, 3, 5, 8])) for i in range(40)]
    return (
        Mapping(spark.createDataFrame(boats, "id int, price double, colour string"), Iri(E + "boat/", "id"), E + "Boat", {E + "price": Literal("price", XSD + "double"), E + "colour": Literal("colour")}),
        Mapping(
            spark.createDataFrame(legs, "id string, boat long, miles int, crew int"), Iri(E + "leg/", "id"), E + "Leg",
            {E + "boat": Iri(E + "boat/", "boat"), E + "miles": Literal("miles", XSD + "integer"), E + "crew": Literal("crew", XSD + "integer")},
        ),
    )


EXTRAS = {
    "none": [],
    "nodes": [(iri(E + "boat/3"), E + "odd", literal("x")), (iri(E + "leg/l1"), E + "odd", literal("y"))],
    "values": [(iri(E + "boat/3"), E + "price", literal("60.0", XSD + "double")), (iri(E + "leg/l2"), E + "boat", iri(E + "boat/4"))],
}


def term(r):
    return Term(r.kind, r.lex, r.dt, r.lang)


def found(graph, mode):
    """The results of all shapes in one run."""
    shapes = "\n".join(x.replace("ex:S ", f"ex:S{i} ", 1) for i, x in enumerate(SHAPES))
    rows = validate_triples(graph, read_triples(HEAD + shapes), mode).results.collect()
    return Counter((r.source_shape if r.path is None else r.detail, r.focus, r.path, r.value, r.component) for r in rows)


@pytest.mark.parametrize("extra", EXTRAS)
def test_rows_as_triples(spark, tables, extra):
    mapped = MappedGraph(list(tables), EXTRAS[extra])
    stored = TripleGraph.of(spark, [(term(r.s), r.p, term(r.o)) for r in mapped.triples().collect()])
    for mode in (STRICT, COMPAT) if extra == "none" else (STRICT,):
        got = found(mapped, mode)
        assert got == found(stored, mode) and len({k[0] for k in got}) > len(SHAPES) // 2
