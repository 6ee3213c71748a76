"""Registered queries: shapes over the star schema as a mapped graph, with DuckDB SQL of the same violations.

Each query validates one shape and returns its results, in which ``focus`` and ``value`` are N-Triples text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import validate_triples
from .graph import Dataset, Iri, Literal, MappedGraph, Mapping
from .operators import targets
from .plans.compile import Compiler
from .plans.ir import Alternative, Closure, Inverse, Path, Predicate, Sequence, Target
from .sources.readers import read_triples
from .terms import RDFS, XSD, Term, iri, text_of

EX = "http://example.org/"
PREFIXES = f"""@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix ex: <{EX}> . @prefix xsd: <{XSD}> .
@prefix rdfs: <{RDFS}> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
"""
INT, DOUBLE, TIME = XSD + "integer", XSD + "double", XSD + "dateTime"


def node(kind: str, column: str) -> Iri:
    return Iri(f"{EX}{kind}/", column)


def ex(name: str) -> str:
    return EX + name


#: (subject, class, predicates) of each table; a column is an IRI of a table or a literal of a datatype.
TABLES: dict[str, tuple] = {
    "region": (node("region", "r_regionkey"), "Region", {"r_name": Literal("r_name")}),
    "nation": (
        node("nation", "n_nationkey"),
        "Nation",
        {"n_name": Literal("n_name"), "region": node("region", "n_regionkey")},
    ),
    "customer": (
        node("customer", "c_custkey"),
        "Customer",
        {
            "c_name": Literal("c_name"),
            "segment": Literal("c_mktsegment"),
            "acctbal": Literal("c_acctbal", DOUBLE),
            "nation": node("nation", "c_nationkey"),
            "key": node("key", "c_nationkey"),
        },
    ),
    "orders": (
        node("order", "o_orderkey"),
        "Order",
        {
            "customer": node("customer", "o_custkey"),
            "status": Literal("o_orderstatus"),
            "priority": Literal("o_orderpriority"),
            "totalprice": Literal("o_totalprice", DOUBLE),
            "orderdate": Literal("o_orderdate", TIME),
            "selfkey": node("key", "o_orderkey"),
            "custkey": node("key", "o_custkey"),
        },
    ),
    "part": (
        node("part", "p_partkey"),
        "Part",
        {"p_name": Literal("p_name"), "brand": Literal("p_brand"), "size": Literal("p_size", INT)},
    ),
    "events": (
        node("event", "event_id"),
        "Event",
        {
            "user": node("user", "user_id"),
            "event_type": Literal("event_type"),
            "amount": Literal("value", DOUBLE),
            "props": Literal("props"),
            "ts": Literal("ts", TIME),
        },
    ),
    "documents": (
        node("document", "doc_id"),
        "Document",
        {"text": Literal("text", lang="lang"), "source": Literal("source"), "insource": node("source", "source")},
    ),
    "labels": (node("document", "doc_id"), "Labelled", {"quality": Literal("quality", INT), "toxic": Literal("toxic", INT)}),
    "pages": (node("page", "page_id"), "Page", {"url": Literal("url")}),
}


def mapped(spark: SparkSession, sf_dir: str, *names: str, extra=()) -> MappedGraph:
    """The named tables as one graph. Line items get the order and a row number of their own as their subject."""
    out = []
    for n in names:
        frame = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        if n == "lineitem":
            out.append(lineitem(frame))
        elif n == "conversations":
            out.append(conversations(frame))
        else:
            subject, cls, preds = TABLES[n]
            out.append(Mapping(frame, subject, ex(cls), {ex(p): o for p, o in preds.items()}))
    return MappedGraph(out, extra)


def lineitem(frame: DataFrame) -> Mapping:
    """Line items have no key. A row's subject is a hash of all its columns, which tells different rows apart; equal rows
    are one node, so they are combined first. A row id would change when a task is run again."""
    row = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.hex(F.xxhash64(*frame.columns)))
    preds = {
        "order": node("order", "l_orderkey"),
        "linepart": node("part", "l_partkey"),
        "quantity": Literal("l_quantity", DOUBLE),
        "price": Literal("l_extendedprice", DOUBLE),
        "returnflag": Literal("l_returnflag"),
        "shipdate": Literal("l_shipdate", TIME),
    }
    return Mapping(frame.withColumn("_row", row).dropDuplicates(["_row"]), node("lineitem", "_row"), ex("Lineitem"), {ex(p): o for p, o in preds.items()})


def conversations(frame: DataFrame) -> Mapping:
    at = lambda k: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + k).cast("string"))
    rows = frame.withColumns({"_at": at(0), "_next": at(1)})
    preds = {"role": Literal("role"), "said": Literal("text"), "next": node("turn", "_next")}
    return Mapping(rows, node("turn", "_at"), ex("Turn"), {ex(p): o for p, o in preds.items()})


def run(tables: str, shapes: str, extra=()) -> Callable[[SparkSession, str], DataFrame]:
    """A query that validates ``shapes`` (Turtle) over ``tables`` and returns (focus, path, value, component)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = mapped(spark, sf_dir, *tables.split(), extra=extra)
        report = validate_triples(graph, read_triples(PREFIXES + shapes))
        return report.results.select("focus", "value", F.regexp_extract("component", "#(.*)ConstraintComponent$", 1).alias("component"))

    return query


def sql(body: str, focus: str, value: str | None, component: str) -> str:
    return f"SELECT {focus} AS focus, {value or 'CAST(NULL AS VARCHAR)'} AS value, '{component}' AS component FROM {body}"


def n(kind: str, column: str) -> str:
    return f"concat('<{EX}{kind}/', {column}, '>')"


shape = "ex:S a sh:NodeShape ; "

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        SQL[name] = oracle


def focus_only(query):
    """(focus) of the results: for values whose text the two engines spell differently, such as doubles and times."""
    return lambda spark, d: query(spark, d).select("focus", "component")


def focus_sql(body: str, focus: str, component: str) -> str:
    return f"SELECT {focus} AS focus, '{component}' AS component FROM {body}"


# cardinality -------------------------------------------------------------------------------------------------------
add(
    "min_count_inverse",
    run("orders lineitem", shape + "sh:targetClass ex:Order ; sh:property [ sh:path [ sh:inversePath ex:order ] ; sh:minCount 1 ] ."),
    sql("orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", n("order", "o_orderkey"), None, "MinCount"),
)
add(
    "max_count_inverse",
    run("orders lineitem", shape + "sh:targetClass ex:Order ; sh:property [ sh:path [ sh:inversePath ex:order ] ; sh:maxCount 8 ] ."),
    sql("(SELECT l_orderkey FROM (SELECT DISTINCT * FROM lineitem) SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 8)", n("order", "l_orderkey"), None, "MaxCount"),
)
add(
    "has_value",
    run("orders lineitem", shape + 'sh:targetClass ex:Order ; sh:property [ sh:path ( [ sh:inversePath ex:order ] ex:returnflag ) ; sh:hasValue "R" ] .'),
    sql("orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", n("order", "o_orderkey"), None, "HasValue"),
)
QUAL = "sh:qualifiedValueShape [ sh:property [ sh:path ex:quantity ; sh:minExclusive 40.0 ] ]"
CNT = "(SELECT o_orderkey, coalesce(c, 0) c FROM orders LEFT JOIN (SELECT l_orderkey, count(*) c FROM (SELECT DISTINCT * FROM lineitem) WHERE l_quantity > 40 GROUP BY 1) ON l_orderkey = o_orderkey)"
add(
    "qualified_min",
    run("orders lineitem", shape + f"sh:targetClass ex:Order ; sh:property [ sh:path [ sh:inversePath ex:order ] ; {QUAL} ; sh:qualifiedMinCount 1 ] ."),
    sql(f"{CNT} WHERE c < 1", n("order", "o_orderkey"), None, "QualifiedMinCount"),
)
add(
    "qualified_max",
    run("orders lineitem", shape + f"sh:targetClass ex:Order ; sh:property [ sh:path [ sh:inversePath ex:order ] ; {QUAL} ; sh:qualifiedMaxCount 2 ] ."),
    sql(f"{CNT} WHERE c > 2", n("order", "o_orderkey"), None, "QualifiedMaxCount"),
)
SIB = """sh:property [ sh:path [ sh:inversePath ex:order ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 2 ;
  sh:qualifiedValueShape [ sh:property [ sh:path ex:quantity ; sh:minExclusive 40.0 ] ] ] ;
sh:property [ sh:path [ sh:inversePath ex:order ] ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedMinCount 0 ;
  sh:qualifiedValueShape [ sh:property [ sh:path ex:returnflag ; sh:hasValue "R" ] ] ] ."""
add(
    "qualified_disjoint",
    run("orders lineitem", shape + "sh:targetClass ex:Order ; " + SIB),
    sql("(SELECT o_orderkey, coalesce(c, 0) c FROM orders LEFT JOIN (SELECT l_orderkey, count(*) c FROM (SELECT DISTINCT * FROM lineitem) WHERE l_quantity > 40 AND l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey) WHERE c < 2", n("order", "o_orderkey"), None, "QualifiedMinCount"),
)
# one value at a time -----------------------------------------------------------------------------------------------
def typed(column: str, dt: str) -> str:
    """A typed literal's text in SQL."""
    return f"concat('\"', {column}, '\"^^<{dt}>')"


def quoted(column: str) -> str:
    """A string's text in SQL, escaped as N-Triples has it."""
    out = f"replace({column}, '\\', '\\\\')"
    for c, e in (("'\"'", '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        out = f"replace({out}, {c}, '{e}')"
    return f"concat('\"', {out}, '\"')"


SAID = f"concat({quoted('text')}, '@', lower(lang))"
VALUE_LOCAL = [
    ("min_inclusive", "customer", "Customer", "ex:acctbal", "sh:minInclusive 0.0", "customer WHERE NOT c_acctbal >= 0", n("customer", "c_custkey"), typed("c_acctbal", DOUBLE), "MinInclusive"),
    ("min_exclusive", "part", "Part", "ex:size", "sh:minExclusive 1", "part WHERE NOT p_size > 1", n("part", "p_partkey"), typed("p_size", INT), "MinExclusive"),
    ("max_inclusive", "orders", "Order", "ex:totalprice", "sh:maxInclusive 400000.0", "orders WHERE NOT o_totalprice <= 400000", n("order", "o_orderkey"), typed("o_totalprice", DOUBLE), "MaxInclusive"),
    ("max_exclusive", "orders", "Order", "ex:totalprice", "sh:maxExclusive 50000", "orders WHERE NOT o_totalprice < 50000", n("order", "o_orderkey"), typed("o_totalprice", DOUBLE), "MaxExclusive"),
    ("in_role", "conversations", "Turn", "ex:role", 'sh:in ( "user" "assistant" )', "conversations WHERE role NOT IN ('user', 'assistant')", n("turn", "conv_id, '-', turn"), quoted("role"), "In"),
    ("pattern", "pages", "Page", "ex:url", 'sh:pattern "^https://"', "pages WHERE NOT regexp_matches(url, '^https://')", n("page", "page_id"), quoted("url"), "Pattern"),
    ("pattern_flags", "part", "Part", "ex:p_name", 'sh:pattern "RING" ; sh:flags "i"', "part WHERE NOT regexp_matches(p_name, '(?i)RING')", n("part", "p_partkey"), quoted("p_name"), "Pattern"),
    ("min_length", "documents", "Document", "ex:text", "sh:minLength 100", "documents WHERE length(text) < 100", n("document", "doc_id"), SAID, "MinLength"),
    ("max_length", "documents", "Document", "ex:text", "sh:maxLength 5000", "documents WHERE length(text) > 5000", n("document", "doc_id"), SAID, "MaxLength"),
    ("language_in", "documents", "Document", "ex:text", 'sh:languageIn ( "en" "fr" )', "documents WHERE lower(lang) NOT IN ('en', 'fr')", n("document", "doc_id"), SAID, "LanguageIn"),
]
for name, tables, cls, path, test, body, focus, value, component in VALUE_LOCAL:
    add(name, run(tables, f"{shape} sh:targetClass ex:{cls} ; sh:property [ sh:path {path} ; {test} ] ."), sql(body, focus, value, component))
MIXED = "sh:targetClass ex:Order ; sh:property [ sh:path [ sh:alternativePath ( ex:status ex:customer ) ] ; "
add(
    "datatype",
    run("orders", shape + MIXED + "sh:datatype xsd:string ] ."),
    sql("orders", n("order", "o_orderkey"), n("customer", "o_custkey"), "Datatype"),
)
add(
    "node_kind",
    run("orders", shape + MIXED + "sh:nodeKind sh:IRI ] ."),
    sql("orders", n("order", "o_orderkey"), "concat('\"', o_orderstatus, '\"')", "NodeKind"),
)
add(
    "fused_value_tests",
    run("orders", shape + "sh:targetClass ex:Order ; sh:property [ sh:path ex:totalprice ; sh:minInclusive 1000.0 ; sh:maxInclusive 400000.0 ; sh:datatype xsd:double ] ."),
    sql("orders WHERE o_totalprice > 400000", n("order", "o_orderkey"), typed("o_totalprice", DOUBLE), "MaxInclusive") + " UNION ALL " + sql("orders WHERE o_totalprice < 1000", n("order", "o_orderkey"), typed("o_totalprice", DOUBLE), "MinInclusive"),
)
# pairs of properties ----------------------------------------------------------------------------------------------
add(
    "unique_lang",
    run("documents", shape + "sh:targetObjectsOf ex:insource ; sh:property [ sh:path ( [ sh:inversePath ex:insource ] ex:text ) ; sh:uniqueLang true ] ."),
    sql("(SELECT source, lang FROM documents GROUP BY 1, 2 HAVING count(DISTINCT text) > 1)", n("source", "source"), None, "UniqueLang"),
)
for name, op, word in (("less_than", "<", "lessThan"), ("less_or_equal", "<=", "lessThanOrEquals")):
    late = run("orders lineitem", shape + f"sh:targetClass ex:Lineitem ; sh:property [ sh:path ( ex:order ex:orderdate ) ; sh:{word} ex:shipdate ] .")
    add(
        name,
        # a row's subject ends in a hash that DuckDB has not: results are counted by order and line
        lambda spark, d, q=late: (
            q(spark, d).groupBy(F.regexp_extract("focus", "lineitem/([0-9]+-[0-9]+)-", 1).alias("line")).agg(F.count("*").alias("n"))
        ),
        "SELECT concat(l_orderkey, '-', l_linenumber) AS line, count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) "
        f"JOIN orders ON l_orderkey = o_orderkey WHERE NOT o_orderdate {op} l_shipdate GROUP BY 1",
    )
add(
    "disjoint",
    run("orders", shape + "sh:targetClass ex:Order ; sh:property [ sh:path ex:custkey ; sh:disjoint ex:selfkey ] ."),
    sql("orders WHERE o_custkey = o_orderkey", n("order", "o_orderkey"), n("key", "o_custkey"), "Disjoint"),
)
add(
    "equals",
    run("customer nation", shape + "sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:equals ex:key ] ."),
    sql("customer", n("customer", "c_custkey"), n("nation", "c_nationkey"), "Equals") + " UNION ALL " + sql("customer", n("customer", "c_custkey"), n("key", "c_nationkey"), "Equals"),
)
# classes, nested shapes, logic --------------------------------------------------------------------------------------
NATIONS = read_triples(PREFIXES + "".join(f"<{EX}nation/{k}> a ex:Inner . " for k in range(0, 25, 5)) + "ex:Inner rdfs:subClassOf ex:Area .")
add(
    "class_check",
    run("customer", shape + "sh:targetClass ex:Customer ; sh:property [ sh:path ex:nation ; sh:class ex:Area ] .", NATIONS),
    sql("customer WHERE c_nationkey % 5 <> 0", n("customer", "c_custkey"), n("nation", "c_nationkey"), "Class"),
)
add(
    "class_via_path",
    run("customer nation", shape + f"sh:targetClass ex:Customer ; sh:property [ sh:path ( ex:nation ex:region ) ; sh:in ( <{EX}region/1> ) ] ."),
    sql("customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1", n("customer", "c_custkey"), n("region", "n_regionkey"), "In"),
)
BIG = "[ sh:property [ sh:path ex:totalprice ; sh:minInclusive 50000.0 ] ]"
add(
    "node",
    (lambda q: lambda spark, d: q(spark, d).groupBy("value", "component").agg(F.count("*").alias("n")))(
        run("orders lineitem", shape + f"sh:targetClass ex:Lineitem ; sh:property [ sh:path ex:order ; sh:node {BIG} ] .")
    ),
    f"SELECT {n('order', 'o_orderkey')} AS value, 'Node' AS component, count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE NOT o_totalprice >= 50000 GROUP BY 1",
)
LOW, BUY = "[ sh:property [ sh:path ex:amount ; sh:maxExclusive 50.0 ] ]", '[ sh:property [ sh:path ex:event_type ; sh:hasValue "purchase" ] ]'
EVENT = n("event", "event_id")
for name, test, body in (
    ("and", f"sh:and ( {LOW} {BUY} )", "NOT (value < 50 AND event_type = 'purchase')"),
    ("or", f"sh:or ( {LOW} {BUY} )", "NOT (value < 50 OR event_type = 'purchase')"),
    ("xone", f"sh:xone ( {LOW} {BUY} )", "(value < 50) = (event_type = 'purchase')"),
    ("not", f"sh:not [ sh:and ( {LOW} {BUY} ) ]", "value < 50 AND event_type = 'purchase'"),
):
    add(
        name,
        run("events", shape + f"sh:targetClass ex:Event ; {test} ."),
        sql(f"events WHERE {body}", EVENT, EVENT, name.capitalize()),
    )
add(
    "closed",
    run("events", shape + "sh:targetClass ex:Event ; sh:closed true ; sh:ignoredProperties ( rdf:type ex:ts ex:user ) ; sh:property [ sh:path ex:amount ] ; sh:property [ sh:path ex:props ] ."),
    sql("events", EVENT, "concat('\"', event_type, '\"')", "Closed"),
)
add(
    "nested_property",
    run("customer orders", shape + "sh:targetClass ex:Order ; sh:property [ sh:path ex:customer ; sh:property [ sh:path ex:segment ; sh:in ( \"BUILDING\" \"MACHINERY\" ) ] ] ."),
    sql("orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", n("customer", "c_custkey"), "concat('\"', c_mktsegment, '\"')", "In"),
)


# paths -----------------------------------------------------------------------------------------------------------
def along(tables: str, cls: str, path: Path) -> Callable[[SparkSession, str], DataFrame]:
    """(focus, value) of a path from all instances of a class."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = mapped(spark, sf_dir, *tables.split())
        foci = targets.resolve_target(Target("class", iri(ex(cls))), g)
        out = Compiler(Dataset(g)).values(path, foci, g.home([ex(cls)]))
        return out.select(text_of(F.col("focus")).alias("focus"), text_of(F.col("value")).alias("value"))

    return query


NEXT = Predicate(ex("next"))
TURN = "concat(conv_id, '-', turn)"
EDGES = f"e AS (SELECT {TURN} AS s, concat(conv_id, '-', turn + 1) AS o FROM conversations)"
RECURSIVE = f"WITH RECURSIVE {EDGES}, w(s, o) AS (SELECT s, o FROM e UNION SELECT w.s, e.o FROM w JOIN e ON w.o = e.s)"
OUT = f"SELECT DISTINCT concat('<{EX}turn/', s, '>') AS focus, concat('<{EX}turn/', o, '>') AS value"
SELF = "(SELECT s, o FROM w UNION SELECT s, s FROM e)"
add("path_predicate", along("orders", "Order", Predicate(ex("customer"))), f"SELECT {n('order', 'o_orderkey')} AS focus, {n('customer', 'o_custkey')} AS value FROM orders")
add("path_inverse", along("orders customer", "Customer", Inverse(Predicate(ex("customer")))), f"SELECT {n('customer', 'o_custkey')} AS focus, {n('order', 'o_orderkey')} AS value FROM orders SEMI JOIN customer ON o_custkey = c_custkey")
add(
    "path_sequence",
    along("orders customer nation", "Order", Sequence((Predicate(ex("customer")), Predicate(ex("nation")), Predicate(ex("region"))))),
    f"SELECT DISTINCT {n('order', 'o_orderkey')} AS focus, {n('region', 'n_regionkey')} AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
add(
    "path_alternative",
    along("orders", "Order", Alternative((Predicate(ex("customer")), Predicate(ex("status"))))),
    f"SELECT {n('order', 'o_orderkey')} AS focus, {n('customer', 'o_custkey')} AS value FROM orders UNION SELECT {n('order', 'o_orderkey')}, concat('\"', o_orderstatus, '\"') FROM orders",
)
add("path_zero_or_more", along("conversations", "Turn", Closure(NEXT, 0)), f"{RECURSIVE} {OUT} FROM {SELF}")
add("path_one_or_more", along("conversations", "Turn", Closure(NEXT, 1)), f"{RECURSIVE} {OUT} FROM w")
add("path_zero_or_one", along("conversations", "Turn", Closure(NEXT, 0, False)), f"WITH {EDGES} {OUT} FROM (SELECT s, o FROM e UNION SELECT s, s FROM e)")


# targets ---------------------------------------------------------------------------------------------------------
def focus_of(tables: str, target: Target, extra=()) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = mapped(spark, sf_dir, *tables.split(), extra=extra)
        return targets.resolve_target(target, g).select(text_of(F.col("focus")).alias("focus"))

    return query


UP = read_triples(PREFIXES + "ex:Order rdfs:subClassOf ex:Deal . ex:Customer rdfs:subClassOf ex:Party . ex:Party rdfs:subClassOf ex:Deal . ex:customer rdfs:subPropertyOf ex:refers .")
add("target_node", focus_of("region", Target("node", Term("literal", "x", XSD + "string"))), "SELECT '\"x\"' AS focus")
add("target_class_subclass", focus_of("orders customer", Target("class", iri(ex("Deal"))), UP), f"SELECT {n('order', 'o_orderkey')} AS focus FROM orders UNION ALL SELECT {n('customer', 'c_custkey')} FROM customer")
add("target_subjects_of", focus_of("labels", Target("subjects", iri(ex("quality")))), f"SELECT DISTINCT {n('document', 'doc_id')} AS focus FROM labels WHERE quality IS NOT NULL")
add("target_objects_of", focus_of("orders", Target("objects", iri(ex("refers"))), UP), f"SELECT DISTINCT {n('customer', 'o_custkey')} AS focus FROM orders")


# reports ---------------------------------------------------------------------------------------------------------
SEVERE = """ex:A a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:totalprice ; sh:maxInclusive 400000.0 ; sh:severity sh:Warning ] .
ex:B a sh:NodeShape ; sh:targetClass ex:Customer ; sh:severity sh:Info ; sh:property [ sh:path ex:acctbal ; sh:minInclusive 0.0 ] ."""


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_triples(mapped(spark, sf_dir, "orders", "customer"), read_triples(PREFIXES + SEVERE)).by_severity()


add(
    "report_by_severity",
    severities,
    "SELECT 'http://www.w3.org/ns/shacl#Warning' AS severity, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'http://www.w3.org/ns/shacl#Violation', count(*) FROM customer WHERE c_acctbal < 0",
)


def conforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = mapped(spark, sf_dir, "orders", "customer")
    report = validate_triples(graph, read_triples(PREFIXES + SEVERE))
    return report.results.agg((F.count("*") == 0).alias("conforms"))


add("conforms", conforms, "SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 400000) + (SELECT count(*) FROM customer WHERE c_acctbal < 0) = 0 AS conforms")


def closed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples each predicate of a mapped graph has."""
    return mapped(spark, sf_dir, "orders", "customer", "events").triples().groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


PREDICATES = " UNION ALL ".join(
    f"SELECT '{ex(p)}' AS predicate, count({c}) AS n FROM {t}"
    for t, some in (("orders", TABLES["orders"][2]), ("customer", TABLES["customer"][2]), ("events", TABLES["events"][2]))
    for p, o in some.items()
    for c in [o.column]
)
add(
    "mapped_triples",
    closed_triples,
    f"SELECT predicate, n FROM ({PREDICATES}) WHERE n > 0 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM events)",
)


# SPARQL -----------------------------------------------------------------------------------------------------------
DECLARE = f'ex:P sh:declare [ sh:prefix "ex" ; sh:namespace "{EX}" ] . '
add(
    "sparql_select",
    focus_only(
        run(
            "orders customer",
            DECLARE
            + shape
            + 'sh:targetClass ex:Order ; sh:sparql [ sh:prefixes ex:P ; sh:message "order of {?value}" ; sh:select """'
            + "SELECT $this ?value WHERE { $this ex:customer ?value ; ex:totalprice ?t . ?value ex:acctbal ?b . FILTER(?t > 450000 && ?b < 0) }"
            + '""" ] .',
        )
    ),
    focus_sql("orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000 AND c_acctbal < 0", n("order", "o_orderkey"), "SPARQL"),
)
add(
    "sparql_ask_component",
    lambda spark, d: (
        run(
            "orders customer",
            DECLARE
            + """ex:CConstraintComponent a sh:ConstraintComponent ; sh:parameter [ sh:path ex:least ] ;
  sh:nodeValidator [ a sh:SPARQLAskValidator ; sh:prefixes ex:P ; sh:ask \"\"\"ASK { ?o ex:customer $this ; ex:totalprice ?t . FILTER(?t > $least) }\"\"\" ] .
ex:S a sh:NodeShape ; sh:targetClass ex:Customer ; ex:least 300000 .""",
        )(spark, d).select("focus")
    ),
    f"SELECT {n('customer', 'c_custkey')} AS focus FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
)


def asked(tables: str, text: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose solutions are returned as texts of literals or IRIs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .sparql.evaluate import run_query

        out = run_query(Dataset(mapped(spark, sf_dir, *tables.split())), text, {"ex": EX, "xsd": XSD})
        return out.select(*(F.col(x)["lex"].alias(x) for x in names))

    return query


add(
    "sparql_group_having",
    asked(
        "orders customer",
        "SELECT ?seg (COUNT(?o) AS ?n) (MAX(?d) AS ?last) WHERE { ?o ex:customer ?c ; ex:orderdate ?d . ?c ex:segment ?seg } GROUP BY ?seg HAVING (COUNT(?o) > 10)",
        "seg", "n",
    ),
    "SELECT c_mktsegment AS seg, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 10",
)
add(
    "sparql_optional_union",
    asked(
        "orders customer",
        """SELECT ?c ?o WHERE { { ?c ex:segment "BUILDING" } UNION { ?c ex:segment "MACHINERY" }
           OPTIONAL { ?o ex:customer ?c ; ex:totalprice ?t FILTER(?t > 400000) } FILTER NOT EXISTS { ?c ex:nation <http://example.org/nation/3> } }""",
        "c", "o",
    ),
    f"""SELECT concat('{EX}customer/', c_custkey) AS c, CASE WHEN o_orderkey IS NULL THEN NULL ELSE concat('{EX}order/', o_orderkey) END AS o
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3""",
)
add(
    "sparql_order_limit",
    asked("orders", "SELECT ?o WHERE { ?o ex:totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10 OFFSET 5", "o"),
    f"SELECT concat('{EX}order/', o_orderkey) AS o FROM orders ORDER BY o_totalprice DESC, concat('{EX}order/', o_orderkey) LIMIT 10 OFFSET 5",
)
add(
    "sparql_path_bind",
    asked(
        "orders customer nation",
        "SELECT DISTINCT ?r ?k WHERE { ?o ex:status \"F\" ; ex:customer/ex:nation/ex:region ?r . BIND(STRAFTER(STR(?r), \"region/\") AS ?k) VALUES ?k { \"1\" \"2\" } }",
        "r", "k",
    ),
    f"SELECT DISTINCT concat('{EX}region/', n_regionkey) AS r, CAST(n_regionkey AS VARCHAR) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND n_regionkey IN (1, 2)",
)
