"""Registered queries of targets, modifiers, formats, hierarchies, reports and streams, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import lint_data_graph, validate, validate_shape, validate_triples
from .functions.values import local_name, text_length
from .graph import SUBCLASS, SUBPROPERTY, Dataset, Graph, Mapping, TripleGraph
from .operators.targets import Targets, resolve_target
from .plans.compile import COMPONENTS, register_component
from .plans.ir import Constraint, Predicate, Shape, Target
from .plans.mode import COMPAT, STRICT, Mode
from .plans.shapes import ShapesGraph, parse_shape, parse_shapes
from .queries import EX, PREFIXES, TABLES, UP, add, ex, mapped, n, run, shape, sql
from .sources.readers import ALIASES, read_triples, to_text
from .streaming.rows import validate_stream
from .terms import SH, XSD, Term, iri, literal, text_of

VIOLATION = SH + "Violation"


def table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows that a query makes on the driver, such as those of a parsed text."""
    return spark.createDataFrame(list(rows), schema)


def listed(rows: Iterable[tuple], *columns: str) -> str:
    """Constant rows of text in SQL."""
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) t({', '.join(columns)})"


def escaped(column: str) -> str:
    """A column's text as N-Triples writes it, in SQL."""
    out = f"replace({column}, '\\', '\\\\')"
    for c, e in (("'\"'", '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        out = f"replace({out}, {c}, '{e}')"
    return f"concat('\"', {out}, '\"')"


# targets -------------------------------------------------------------------------------------------------------------
def focused(tables: str, shapes: str, extra=()) -> Callable[[SparkSession, str], DataFrame]:
    """The distinct focus nodes of the first shape of a text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = mapped(spark, sf_dir, *tables.split(), extra=extra)
        found = Targets(graph).of(parse_shapes(read_triples(PREFIXES + shapes))[0].targets)
        return found.select(text_of(F.col("focus")).alias("focus"))

    return query


add(
    "target_implicit",
    run("region nation", 'ex:Region a sh:NodeShape, rdfs:Class ; sh:property [ sh:path ex:r_name ; sh:minLength 6 ] .'),
    sql("region WHERE length(r_name) < 6", n("region", "r_regionkey"), escaped("r_name"), "MinLength"),
)
add(
    "target_union",
    focused("orders customer", f"ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:targetObjectsOf ex:customer ; sh:targetNode <{EX}customer/1>, ex:other ."),
    f"SELECT {n('customer', 'c_custkey')} AS focus FROM customer UNION SELECT {n('customer', 'o_custkey')} FROM orders UNION SELECT '<{EX}customer/1>' UNION SELECT '<{EX}other>'",
)
add(
    "target_advanced",
    focused("region", "ex:S a sh:NodeShape ; sh:target [ a ex:Anything ] ; sh:targetNode ex:one ."),
    f"SELECT '<{EX}one>' AS focus",
)
add(
    "target_subproperty",
    lambda spark, d: resolve_target(Target("subjects", iri(ex("refers"))), mapped(spark, d, "orders", extra=UP)).select(text_of(F.col("focus")).alias("focus")),
    f"SELECT {n('order', 'o_orderkey')} AS focus FROM orders",
)
SHAPES = """ex:A a sh:NodeShape ; rdfs:label "first" ; sh:description "text" ; sh:targetClass ex:Order ; sh:property ex:B, [ sh:path ex:status ; sh:name "own" ; sh:in ( "F" "O" ) ] .
ex:B a sh:PropertyShape ; sh:path ( ex:customer [ sh:inversePath ex:customer ] ) ; sh:severity sh:Info ; sh:minCount 2 ; sh:maxCount 4 .
ex:C sh:targetNode 5 ; sh:deactivated true ; sh:nodeKind sh:IRI . ex:D sh:targetSubjectsOf ex:status ."""
FOUND = [
    ("A", None, "first", "text", "Violation", False, 1, 3, 2),
    ("B", f"<{EX}customer>/^<{EX}customer>", None, None, "Info", False, 0, 2, 0),
    ("C", None, None, None, "Violation", True, 1, 1, 0),
    ("D", None, None, None, "Violation", False, 1, 0, 0),
]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader finds of each shape: its name, modifiers and sizes."""
    rows = []
    for s in parse_shapes(read_triples(PREFIXES + SHAPES)):
        c = s.counts()
        path = str(s.path) if s.path else None
        rows.append((local_name(s.node.lex), path, s.name or None, s.description or None, local_name(s.severity), s.deactivated, c["targets"], c["constraints"], c["properties"]))
    return table(spark, rows, "shape string, path string, name string, description string, severity string, deactivated boolean, targets long, constraints long, properties long")


add("shape_discovery", parsed, listed(FOUND, "shape", "path", "name", "description", "severity", "deactivated", "targets", "constraints", "properties"))
add(
    "parse_one_shape",
    lambda spark, d: table(spark, [(line,) for line in parse_shape(read_triples(PREFIXES + SHAPES), iri(ex("B"))).lines()], "line string"),
    listed([(f"PropertyShape <{EX}B> path <{EX}customer>/^<{EX}customer>",), (f"  severity: <{SH}Info>",), ("  constraint: MinCount[minCount=2]",), ("  constraint: MaxCount[maxCount=4]",)], "line"),
)
# modifiers and results ------------------------------------------------------------------------------------------------
add(
    "deactivated",
    run(
        "customer",
        shape + 'sh:targetClass ex:Customer ; sh:property [ sh:path ex:segment ; sh:maxCount 0 ; sh:deactivated true ], [ sh:path ex:segment ; sh:hasValue "BUILDING" ] . '
        "ex:Off a sh:NodeShape ; sh:targetClass ex:Customer ; sh:deactivated true ; sh:nodeKind sh:Literal .",
    ),
    sql("customer WHERE c_mktsegment <> 'BUILDING'", n("customer", "c_custkey"), None, "HasValue"),
)


def whole(tables: str, shapes: str, mode: Mode = STRICT, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """All columns of the report, or those named."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = validate_triples(mapped(spark, sf_dir, *tables.split()), read_triples(PREFIXES + shapes), mode).results
        return out.select(*columns) if columns else out

    return query


add(
    "result_columns",
    whole("orders", 'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property ex:P . ex:P sh:path ex:totalprice ; sh:name "price" ; sh:message "too much", "zu viel" ; sh:severity sh:Warning ; sh:maxInclusive 440000 .'),
    f"SELECT {n('order', 'o_orderkey')} AS focus, '<{EX}totalprice>' AS path, concat('\"', o_totalprice, '\"^^<{XSD}double>') AS value, '{SH}Warning' AS severity, '<{EX}P>' AS source_shape, 'price' AS source_shape_name, "
    f"'{SH}MaxInclusiveConstraintComponent' AS component, 'MaxInclusive[maxInclusive=\"440000\"^^<{XSD}integer>]' AS detail, ['is not <= 440000', 'too much', 'zu viel'] AS messages, CAST([] AS VARCHAR[]) AS trace, "
    "CAST(NULL AS VARCHAR) AS source_constraint FROM orders WHERE o_totalprice > 440000",
)
add(
    "result_trace",
    whole("events", shape + "sh:targetClass ex:Event ; sh:not [ sh:property [ sh:path ex:amount ; sh:minInclusive 50 ] ] .", STRICT, "focus", "trace"),
    f"SELECT {n('event', 'event_id')} AS focus, ['sh:not validation'] AS trace FROM events WHERE value >= 50",
)
NESTED = """ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:or ( ex:Low ex:Paid ) .
ex:Low sh:property ex:LowP . ex:LowP sh:path ex:totalprice ; sh:maxInclusive 300000 .
ex:Paid sh:and ( ex:F ex:Big ) . ex:F sh:property ex:FP . ex:FP sh:path ex:status ; sh:hasValue "F" . ex:Big sh:property ex:BigP . ex:BigP sh:path ex:totalprice ; sh:minInclusive 400000 ."""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the results of nested logic, each with what it explains."""
    report = validate_triples(mapped(spark, sf_dir, "orders"), read_triples(PREFIXES + NESTED), details=True)
    last = lambda c: F.regexp_extract(c, r"([A-Za-z]+?)(ConstraintComponent)?>?$", 1)
    return report.details().select(
        last("parent_shape").alias("parent_shape"), last("parent_component").alias("parent"), "parent_value", "focus", last("component").alias("component"), last("source_shape").alias("source")
    )


NOT_LOW, NOT_PAID = "o_totalprice > 300000", "(o_orderstatus <> 'F' OR o_totalprice < 400000)"


def detail_sql(parent_shape: str, parent: str, component: str, source: str, where: str) -> str:
    o = n("order", "o_orderkey")
    return f"SELECT '{parent_shape}' AS parent_shape, '{parent}' AS parent, {o} AS parent_value, {o} AS focus, '{component}' AS component, '{source}' AS source FROM orders WHERE {NOT_LOW} AND {NOT_PAID} AND {where}"


add(
    "result_details",
    nested,
    " UNION ALL ".join(
        detail_sql(*x)
        for x in (
            ("S", "Or", "MaxInclusive", "LowP", "true"),
            ("S", "Or", "And", "Paid", "true"),
            ("Paid", "And", "HasValue", "FP", "o_orderstatus <> 'F'"),
            ("Paid", "And", "MinInclusive", "BigP", "o_totalprice < 400000"),
        )
    ),
)
SEVERAL = 'ex:S a sh:NodeShape ; sh:targetClass ex:Region ; sh:property [ sh:path ex:r_name ; sh:maxLength 4 ; sh:message "long" ] .'


def region_report(spark: SparkSession, sf_dir: str):
    return validate_triples(mapped(spark, sf_dir, "region"), read_triples(PREFIXES + SEVERAL))


add(
    "report_text",
    lambda spark, d: table(spark, [(x.strip(),) for x in region_report(spark, d).to_text().splitlines() if "shape:" not in x], "line string"),
    "SELECT unnest(['Conforms: false', concat('Results: ', count(*)), concat('Violation: ', count(*))]) AS line FROM region WHERE length(r_name) > 4 UNION ALL "
    f"SELECT concat(row_number() OVER (ORDER BY {n('region', 'r_regionkey')}), '. Violation at ', {n('region', 'r_regionkey')}) FROM region WHERE length(r_name) > 4 UNION ALL "
    f"SELECT unnest(['path: <{EX}r_name>', concat('value: ', {escaped('r_name')}), 'constraint: MaxLength[maxLength=4]', 'message: is longer than 4', 'message: long']) FROM region WHERE length(r_name) > 4",
)
add(
    "report_json",
    lambda spark, d: region_report(spark, d).json_rows().select(*(F.get_json_object("value", f"$.{k}").alias(k) for k in ("focusNode", "resultPath", "value", "resultSeverity", "sourceConstraintComponent", "resultMessage"))),
    f"SELECT {n('region', 'r_regionkey')} AS \"focusNode\", '<{EX}r_name>' AS \"resultPath\", {escaped('r_name')} AS value, '{VIOLATION}' AS \"resultSeverity\", '{SH}MaxLengthConstraintComponent' AS \"sourceConstraintComponent\", "
    "'[\"is longer than 4\",\"long\"]' AS \"resultMessage\" FROM region WHERE length(r_name) > 4",
)
add(
    "report_rdf",
    lambda spark, d: TripleGraph.of(spark, read_triples(region_report(spark, d).render("ttl"))).triples().groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n")),
    f"SELECT concat('{SH}', p) AS predicate, k AS n FROM (SELECT unnest(['conforms', 'result', 'focusNode', 'resultPath', 'value', 'resultSeverity', 'sourceConstraintComponent', 'sourceShape', 'resultMessage']) AS p, "
    "unnest([1, c, c, c, c, c, c, c, 2 * c]) AS k FROM (SELECT count(*) AS c FROM region WHERE length(r_name) > 4)) UNION ALL "
    "SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) + 1 FROM region WHERE length(r_name) > 4",
)
add(
    "report_lines",
    lambda spark, d: region_report(spark, d).lines().select(F.regexp_extract("value", "#([A-Za-z]+)> ", 1).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("n")),
    "SELECT p AS predicate, k AS n FROM (SELECT unnest(['conforms', 'result', 'focusNode', 'resultPath', 'value', 'resultSeverity', 'sourceConstraintComponent', 'sourceShape', 'resultMessage', 'type']) AS p, "
    "unnest([1, c, c, c, c, c, c, c, 2 * c, c + 1]) AS k FROM (SELECT count(*) AS c FROM region WHERE length(r_name) > 4))",
)
# formats -------------------------------------------------------------------------------------------------------------
TEXTS = {
    "ttl": '@prefix ex: <http://example.org/> . ex:a ex:p 1, "x"@EN ; ex:q ex:b .',
    "nt": f'<{EX}a> <{EX}p> "1"^^<{XSD}integer> .\n<{EX}a> <{EX}p> "x"@en .\n# note\n<{EX}a> <{EX}q> <{EX}b> .',
    "nq": f'<{EX}a> <{EX}p> "1"^^<{XSD}integer> <{EX}g> .\n<{EX}a> <{EX}p> "1"^^<{XSD}integer> <{EX}h> .\n<{EX}a> <{EX}p> "x"@en .\n<{EX}a> <{EX}q> <{EX}b> <{EX}g> .',
    "rdf": f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="{EX}"><rdf:Description rdf:about="{EX}a"><ex:p rdf:datatype="{XSD}integer">1</ex:p><ex:p xml:lang="en">x</ex:p><ex:q rdf:resource="{EX}b"/></rdf:Description></rdf:RDF>',
    "jsonld": f'{{"@context": {{"ex": "{EX}"}}, "@id": "ex:a", "ex:p": [1, {{"@value": "x", "@language": "en"}}], "ex:q": {{"@id": "ex:b"}}}}',
    "trig": '@prefix ex: <http://example.org/> . ex:g { ex:a ex:p 1 , "x"@en . } { ex:a ex:q ex:b . ex:a ex:p 1 . }',
}
READ = [(f"<{EX}a>", ex("p"), f'"1"^^<{XSD}integer>'), (f"<{EX}a>", ex("p"), '"x"@en'), (f"<{EX}a>", ex("q"), f"<{EX}b>")]


def shown(graph: Graph) -> DataFrame:
    return graph.triples().select(text_of(F.col("s")).alias("s"), "p", text_of(F.col("o")).alias("o"))


for fmt in TEXTS:
    add(f"read_{fmt}", lambda spark, d, fmt=fmt: shown(TripleGraph.of(spark, read_triples(TEXTS[fmt], fmt))), listed(READ, "s", "p", "o"))
add(
    "format_aliases",
    lambda spark, d: table(spark, ALIASES.items(), "name string, format string"),
    listed(
        [("turtle", "ttl"), ("ttl", "ttl"), ("ntriples", "nt"), ("n-triples", "nt"), ("nt", "nt"), ("nquads", "nq"), ("n-quads", "nq"), ("nq", "nq"), ("xml", "rdf"), ("rdfxml", "rdf"), ("rdf-xml", "rdf"), ("rdf", "rdf"), ("json-ld", "jsonld"), ("jsonld", "jsonld"), ("trig", "trig")],
        "name", "format",
    ),
)


def rewritten(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """The nations, 25 rows at every size, as a text in a format and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = lambda r: Term(r.kind, r.lex, r.dt, r.lang)
        rows = [(part(r.s), r.p, part(r.o)) for r in mapped(spark, sf_dir, "nation").triples().collect()]
        return shown(TripleGraph.of(spark, read_triples(to_text(rows, fmt), fmt)))

    return query


NATION_TRIPLES = (
    f"SELECT {n('nation', 'n_nationkey')} AS s, '{EX}n_name' AS p, {escaped('n_name')} AS o FROM nation UNION ALL SELECT {n('nation', 'n_nationkey')}, '{EX}region', {n('region', 'n_regionkey')} FROM nation "
    f"UNION ALL SELECT {n('nation', 'n_nationkey')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '<{EX}Nation>' FROM nation"
)
for fmt in TEXTS:
    add(f"write_{fmt}", rewritten(fmt), NATION_TRIPLES)
add(
    "quads",
    lambda spark, d: Dataset(mapped(spark, d, "nation"), read_triples(PREFIXES + SEVERAL)).quads().groupBy(F.coalesce("g", F.lit("default")).alias("g")).agg(F.count("*").alias("n"), F.countDistinct("p").alias("predicates")),
    "SELECT 'default' AS g, 3 * count(*) AS n, 3 AS predicates FROM nation UNION ALL SELECT 'urn:plumbline:shapes-graph', 6, 6",
)
add(
    "graph_union",
    lambda spark, d: shown(TripleGraph(mapped(spark, d, "nation").triples().unionByName(mapped(spark, d, "nation", "region").triples()))).groupBy("p").agg(F.count("*").alias("n")),
    f"SELECT '{EX}n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT '{EX}region', count(*) FROM nation UNION ALL SELECT '{EX}r_name', count(*) FROM region "
    "UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)",
)
BROKEN = ("<http://e/a> <http://e/p> .", "@prefix ex: <http://e/> . ex:a ex:p 1 .", "ex:a ex:p 1 .", "")
add(
    "lint",
    lambda spark, d: table(spark, [(t, lint_data_graph(t) is None) for t in BROKEN], "text string, fine boolean"),
    listed([(BROKEN[0], False), (BROKEN[1], True), (BROKEN[2], False), (BROKEN[3], True)], "text", "fine"),
)
# hierarchies and helpers --------------------------------------------------------------------------------------------------
TREE = "ex:Order rdfs:subClassOf ex:Deal . ex:Rush rdfs:subClassOf ex:Order, ex:Fast . ex:Deal rdfs:subClassOf ex:Thing . ex:Thing rdfs:subClassOf ex:Deal . ex:p rdfs:subPropertyOf ex:q . ex:q rdfs:subPropertyOf ex:r ."


def hierarchy(walk: Callable[[TripleGraph, ShapesGraph], Iterable[tuple]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        triples = read_triples(PREFIXES + TREE)
        return table(spark, walk(TripleGraph.of(spark, triples), ShapesGraph(triples)), "start string, found string")

    return query


add(
    "subclasses",
    hierarchy(lambda g, _: [(c, local_name(x)) for c in ("Deal", "Fast", "Rush") for x in g.below(ex(c), SUBCLASS)]),
    listed([("Deal", "Deal"), ("Deal", "Order"), ("Deal", "Rush"), ("Deal", "Thing"), ("Fast", "Fast"), ("Fast", "Rush"), ("Rush", "Rush")], "start", "found"),
)
add(
    "superclasses",
    hierarchy(lambda _, s: [(c, local_name(x.lex)) for c in ("Rush", "Thing") for x in s.superclasses(iri(ex(c)))]),
    listed([("Rush", "Rush"), ("Rush", "Order"), ("Rush", "Fast"), ("Rush", "Deal"), ("Rush", "Thing"), ("Thing", "Thing"), ("Thing", "Deal")], "start", "found"),
)
add(
    "subproperties",
    hierarchy(lambda g, _: [(c, local_name(x)) for c in ("r", "q") for x in g.below(ex(c), SUBPROPERTY)]),
    listed([("r", "r"), ("r", "q"), ("r", "p"), ("q", "q"), ("q", "p")], "start", "found"),
)
add(
    "superproperties",
    hierarchy(lambda _, s: [(c, local_name(x.lex)) for c in ("p", "r") for x in s.superproperties(iri(ex(c)))]),
    listed([("p", "p"), ("p", "q"), ("p", "r"), ("r", "r")], "start", "found"),
)
add(
    "is_subclass_of",
    hierarchy(lambda _, s: [(a, b + "=" + str(s.is_subclass_of(iri(ex(a)), iri(ex(b)))).lower()) for a, b in (("Rush", "Thing"), ("Fast", "Deal"), ("Order", "Order"))]),
    listed([("Rush", "Thing=true"), ("Fast", "Deal=false"), ("Order", "Order=true")], "start", "found"),
)
LISTS = 'ex:l ex:x ( 1 "two" ex:three ) . ex:c rdf:first 1 ; rdf:rest ex:c . ex:d rdf:first 1 .'


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lists; those that are broken or go in a circle are refused."""
    g = ShapesGraph(read_triples(PREFIXES + LISTS))
    rows = [("l", str(x)) for x in g.items(g.one(iri(ex("l")), ex("x")))]
    for name in ("c", "d"):
        try:
            g.items(iri(ex(name)))
        except ValueError:
            rows.append((name, "refused"))
    return table(spark, rows, "list string, item string")


add("list_guard", lists, listed([("l", f'"1"^^<{XSD}integer>'), ("l", '"two"'), ("l", f"<{EX}three>"), ("c", "refused"), ("d", "refused")], "list", "item"))
TYPED = 'ex:t ex:b true, "false"^^xsd:boolean ; ex:n 7 ; ex:big 3000000000 ; ex:s "seven" ; ex:i ex:x .'


def getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t = ShapesGraph(read_triples(PREFIXES + TYPED)), iri(ex("t"))
    rows = [("number", g.number(t, ex("n"))), ("too big", g.number(t, ex("big"))), ("no number", g.number(t, ex("s"))), ("flag", g.flag(t, ex("b"))), ("no flag", g.flag(t, ex("n"))), ("text", g.text(t, ex("s"))), ("no text", g.text(t, ex("i")))]
    return table(spark, [(k, None if v is None else str(v).lower()) for k, v in rows], "getter string, value string")


add("typed_getters", getters, listed([("number", "7"), ("too big", None), ("no number", None), ("flag", "true"), ("no flag", None), ("text", "seven"), ("no text", None)], "getter", "value"))
add(
    "lexical_length",
    lambda spark, d: mapped(spark, d, "documents").pred(ex("text")).agg(F.sum(text_length(F.col("o"), False)).alias("characters"), F.sum(text_length(F.col("o"), True)).alias("bytes")),
    "SELECT CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents",
)
# the older semantics ---------------------------------------------------------------------------------------------------
DOC = n("document", "doc_id")
add(
    "compat_length_in_bytes",
    whole("documents", shape + "sh:targetClass ex:Document ; sh:property [ sh:path ex:text ; sh:maxLength 5000 ] .", COMPAT, "focus"),
    f"SELECT {DOC} AS focus FROM documents WHERE strlen(text) > 5000",
)
add(
    "compat_unique_lang",
    whole("documents", shape + "sh:targetObjectsOf ex:insource ; sh:property [ sh:path ( [ sh:inversePath ex:insource ] ex:text ) ; sh:uniqueLang true ] .", COMPAT, "focus", "value"),
    f"SELECT {n('source', 'source')} AS focus, concat({escaped('text')}, '@', lower(lang)) AS value FROM (SELECT DISTINCT source, lang, text FROM documents) QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY text COLLATE \"binary\") > 1",
)
add(
    "compat_less_than_any",
    whole("conversations", shape + "sh:targetClass ex:Turn ; sh:property [ sh:path ex:role ; sh:lessThan ex:said ] .", COMPAT, "focus", "value"),
    f"SELECT {n('turn', 'conv_id, chr(45), turn')} AS focus, {escaped('role')} AS value FROM conversations WHERE NOT role < text COLLATE \"binary\"",
)
add(
    "compat_class_exact",
    whole("customer", "ex:Inner rdfs:subClassOf ex:Customer . ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; sh:class ex:Customer ; sh:nodeKind sh:Literal .", COMPAT, "focus", "component"),
    f"SELECT {n('customer', 'c_custkey')} AS focus, '{SH}NodeKindConstraintComponent' AS component FROM customer",
)


# programs ------------------------------------------------------------------------------------------------------------
def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint component that a program adds: values that end in a text."""
    name = ex("EndsConstraintComponent")

    def ends(k, shape, c, foci, vals, home=None):
        return vals.where(~F.col("value.lex").endswith(c.params["end"])).withColumn("message", F.lit(f"doesn't end in {c.params['end']}"))

    register_component(name, ends)
    try:
        inner = Shape(iri(ex("P")), Predicate(ex("segment")), constraints=(Constraint(name, {"end": "Y"}),))
        one = Shape(iri(ex("S")), targets=(Target("class", iri(ex("Customer"))),), properties=(inner,))
        return validate_shape(mapped(spark, sf_dir, "customer"), one).results.select("focus", "value", "messages")
    finally:
        COMPONENTS.pop(name, None)


add(
    "register_component",
    registered,
    f"SELECT {n('customer', 'c_custkey')} AS focus, concat('\"', c_mktsegment, '\"') AS value, ['doesn''t end in Y'] AS messages FROM customer WHERE c_mktsegment NOT LIKE '%Y'",
)
add(
    "shared_targets",
    lambda spark, d: validate(
        mapped(spark, d, "orders"),
        parse_shapes(read_triples(PREFIXES + "".join(f"ex:S{k} a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:totalprice ; sh:maxInclusive {k} ] . " for k in (400000, 440000)))),
    ).results.groupBy("source_shape").count().select(F.col("count").alias("n")),
    "SELECT count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT count(*) FROM orders WHERE o_totalprice > 440000",
)
add(
    "values_by_column",
    whole("conversations", shape + 'sh:targetClass ex:Turn ; sh:property [ sh:path ex:role ; sh:in ( "user" "assistant" ) ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ] .', STRICT, "focus", "value", "component"),
    f"SELECT {n('turn', 'conv_id, chr(45), turn')} AS focus, {escaped('role')} AS value, '{SH}InConstraintComponent' AS component FROM conversations WHERE role NOT IN ('user', 'assistant')",
)
add(
    "closed_selective",
    run(
        "region",
        shape + "sh:targetClass ex:Region ; sh:closed true ; sh:ignoredProperties ( rdf:type ) ; sh:property [ sh:path ex:r_name ] .",
        [(iri(f"{EX}region/1"), ex("odd"), literal("x")), (iri(f"{EX}region/3"), ex("r_name"), literal("more")), (iri(f"{EX}region/99"), ex("odd"), literal("y"))],
    ),
    sql("region WHERE r_regionkey = 1", n("region", "r_regionkey"), "'\"x\"'", "Closed"),
)
add(
    "datatype_ill_formed",
    run(
        "region",
        f"ex:S a sh:NodeShape ; sh:targetSubjectsOf ex:code ; sh:property [ sh:path ex:code ; sh:datatype xsd:integer ] .",
        [(iri(f"{EX}region/{k}"), ex("code"), literal(x, dt)) for k, (x, dt) in enumerate((("7", XSD + "integer"), ("x7", XSD + "integer"), ("7", XSD + "decimal"), ("-0", XSD + "integer"), ("", XSD + "integer")))],
    ),
    sql("(SELECT * FROM region WHERE r_regionkey IN (1, 2, 4))", n("region", "r_regionkey"), f"CASE r_regionkey WHEN 1 THEN '\"x7\"^^<{XSD}integer>' WHEN 2 THEN '\"7\"^^<{XSD}decimal>' ELSE '\"\"^^<{XSD}integer>' END", "Datatype"),
)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape over the events as a stream, run until all that is there is read; the executors write the results to a folder."""
    from .operators.fixpoint import shared_folder

    subject, cls, preds = TABLES["events"]
    # a stream reads a folder or a pattern, and the table may be a single file
    frame = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")
    mapping = Mapping(frame, subject, ex(cls), {ex(p): o for p, o in preds.items()})
    shapes = parse_shapes(read_triples(PREFIXES + shape + "sh:targetClass ex:Event ; sh:property [ sh:path ex:amount ; sh:maxExclusive 100 ] ."))
    results, folder = validate_stream(mapping, shapes).select("focus", "component"), shared_folder(spark, "streamed_results")
    query = results.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append")
    query = query.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{folder}/rows")


add("stream_results", streamed, f"SELECT {n('event', 'event_id')} AS focus, '{SH}MaxExclusiveConstraintComponent' AS component FROM events WHERE NOT value < 100")
