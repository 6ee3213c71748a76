"""Registered SPARQL queries and constraints, with DuckDB SQL of the same solutions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import validate_triples
from .graph import Dataset
from .queries import DECLARE, EX, PREFIXES, add, asked, mapped, n, shape
from .sources.readers import read_triples
from .sparql.evaluate import run_query

CONSTRAINT = DECLARE + shape + 'sh:targetClass ex:%s ; sh:sparql [ sh:prefixes ex:P ; %s sh:select """%s""" ] .'


def constrained(tables: str, cls: str, query: str, message: str = "", more: str = "", *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """The results of a SPARQL constraint on the instances of a class: focus, value and further columns of the report."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shapes = PREFIXES + more + CONSTRAINT % (cls, f'sh:message "{message}" ;' if message else "", query)
        report = validate_triples(mapped(spark, sf_dir, *tables.split()), read_triples(shapes))
        return report.results.select("focus", "value", *columns)

    return run


def i(kind: str, column: str) -> str:
    """An IRI's text in SQL, without brackets."""
    return f"concat('{EX}{kind}/', {column})"


CUSTOMER, ORDER = i("customer", "c_custkey"), i("order", "o_orderkey")
BOTH = "orders JOIN customer ON o_custkey = c_custkey"

# constraints: each focus node is asked by itself ------------------------------------------------------------------------
add(
    "sparql_limit_each",
    constrained("orders customer", "Customer", "SELECT $this ?value WHERE { ?value ex:customer $this ; ex:totalprice ?t } ORDER BY DESC(?t) ?value LIMIT 2"),
    f"SELECT {n('customer', 'o_custkey')} AS focus, {n('order', 'o_orderkey')} AS value FROM orders JOIN customer ON o_custkey = c_custkey "
    f"QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {ORDER}) <= 2",
)
add(
    "sparql_offset_each",
    constrained("orders customer", "Customer", "SELECT $this ?value WHERE { ?value ex:customer $this } ORDER BY ?value LIMIT 1 OFFSET 1"),
    f"SELECT {n('customer', 'o_custkey')} AS focus, {n('order', 'o_orderkey')} AS value FROM orders JOIN customer ON o_custkey = c_custkey "
    f"QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {ORDER}) = 2",
)
add(
    "sparql_count_zero",
    constrained("orders customer", "Customer", "SELECT $this (COUNT(?o) AS ?value) WHERE { ?o ex:customer $this ; ex:status \"P\" } HAVING (COUNT(?o) = 0)"),
    f"SELECT {n('customer', 'c_custkey')} AS focus, '\"0\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
add(
    "sparql_nested_select",
    constrained("orders customer", "Customer", "SELECT $this ?value WHERE { { SELECT $this (MAX(?t) AS ?value) WHERE { ?o ex:customer $this ; ex:totalprice ?t } GROUP BY $this } FILTER(?value > 400000) }"),
    f"SELECT {n('customer', 'o_custkey')} AS focus, concat('\"', max(o_totalprice), '\"^^<http://www.w3.org/2001/XMLSchema#double>') AS value FROM {BOTH} GROUP BY o_custkey HAVING max(o_totalprice) > 400000",
)
add(
    "sparql_message",
    constrained("customer", "Customer", "SELECT $this ?value WHERE { $this ex:segment ?value ; ex:acctbal ?b FILTER(?b < -900) }", "segment {?value} of {$this}{?none}", "", "messages"),
    f"SELECT {n('customer', 'c_custkey')} AS focus, concat('\"', c_mktsegment, '\"') AS value, [concat('segment ', c_mktsegment, ' of ', {CUSTOMER}, '{{?none}}')] AS messages FROM customer WHERE c_acctbal < -900",
)
add(
    "sparql_graph",
    constrained("customer", "Customer", "SELECT $this ?value WHERE { $this ex:segment ?value FILTER NOT EXISTS { GRAPH $shapesGraph { ex:allowed ex:seg ?value } } }", "", 'ex:allowed ex:seg "BUILDING", "MACHINERY" . '),
    f"SELECT {n('customer', 'c_custkey')} AS focus, concat('\"', c_mktsegment, '\"') AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
)
add(
    "sparql_current_shape",
    constrained("customer", "Customer", "SELECT $this ?value WHERE { $this ex:acctbal ?b GRAPH $shapesGraph { $currentShape ex:least ?value } FILTER(?b < ?value) }", "", "ex:S ex:least -500 . "),
    f"SELECT {n('customer', 'c_custkey')} AS focus, '\"-500\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS value FROM customer WHERE c_acctbal < -500",
)
add(
    "sparql_bound_in_groups",
    constrained("orders customer", "Customer", "SELECT $this ?value WHERE { { ?value ex:customer $this ; ex:status \"P\" } UNION { ?value ex:customer $this ; ex:totalprice ?t FILTER(?t > 450000) } }"),
    f"SELECT {n('customer', 'o_custkey')} AS focus, {n('order', 'o_orderkey')} AS value FROM {BOTH} WHERE o_orderstatus = 'P' UNION ALL SELECT {n('customer', 'o_custkey')}, {n('order', 'o_orderkey')} FROM {BOTH} WHERE o_totalprice > 450000",
)


def shaped(tables: str, shapes: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validate_triples(mapped(spark, sf_dir, *tables.split()), read_triples(PREFIXES + DECLARE + shapes)).results.select(*columns)

    return run


add(
    "sparql_property_path",
    shaped(
        "orders customer",
        'ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ( ex:customer ex:segment ) ; sh:sparql [ sh:prefixes ex:P ; sh:select '
        '"SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value = \\"AUTOMOBILE\\") }" ] ] .',
        "focus", "value",
    ),
    f"SELECT {n('order', 'o_orderkey')} AS focus, '\"AUTOMOBILE\"' AS value FROM {BOTH} WHERE c_mktsegment = 'AUTOMOBILE'",
)
COMPONENT = """ex:CConstraintComponent a sh:ConstraintComponent ; sh:parameter [ sh:path ex:cap ] , [ sh:path ex:unused ; sh:optional true ] ;
  sh:message "capped" ; sh:propertyValidator [ a sh:SPARQLSelectValidator ; sh:prefixes ex:P ; sh:select "SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value > $cap) }" ] ;
  sh:validator [ a sh:SPARQLAskValidator ; sh:prefixes ex:P ; sh:ask "ASK { FILTER($value <= $cap) }" ] .
"""
add(
    "sparql_select_component",
    shaped("orders", COMPONENT + "ex:S a sh:NodeShape ; sh:targetClass ex:Order ; sh:property [ sh:path ex:totalprice ; ex:cap 400000 ] .", "focus", "component", "messages"),
    f"SELECT {n('order', 'o_orderkey')} AS focus, '{EX}CConstraintComponent' AS component, ['capped'] AS messages FROM orders WHERE o_totalprice > 400000",
)

# queries --------------------------------------------------------------------------------------------------------------
add(
    "sparql_optional_chain",
    asked("orders customer", 'SELECT ?c ?x WHERE { ?c ex:segment ?s OPTIONAL { ?x ex:customer ?c ; ex:status "P" } OPTIONAL { ?c ex:nation ?x } }', "c", "x"),
    f"SELECT {CUSTOMER} AS c, coalesce(CASE WHEN o_orderkey IS NOT NULL THEN {ORDER} END, {i('nation', 'c_nationkey')}) AS x "
    "FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey",
)
add(
    "sparql_values",
    asked("customer", 'SELECT ?c ?s WHERE { ?c ex:segment ?s ; ex:nation ?n VALUES (?s ?n) { ("BUILDING" UNDEF) (UNDEF <http://example.org/nation/3>) } }', "c", "s"),
    f"SELECT {CUSTOMER} AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {CUSTOMER}, c_mktsegment FROM customer WHERE c_nationkey = 3",
)
add(
    "sparql_exists",
    asked("orders customer", "SELECT ?c WHERE { ?c ex:acctbal ?b FILTER EXISTS { ?o ex:customer ?c ; ex:totalprice ?t FILTER(?t > 50 * ?b) } }", "c"),
    f"SELECT {CUSTOMER} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal)",
)
add(
    "sparql_not_exists_or",
    asked("orders customer", 'SELECT ?c WHERE { ?c ex:segment ?s FILTER(?s = "BUILDING" || NOT EXISTS { ?o ex:customer ?c }) }', "c"),
    f"SELECT {CUSTOMER} AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
add(
    "sparql_minus",
    asked("orders customer", 'SELECT ?c WHERE { ?c ex:segment "BUILDING" MINUS { ?o ex:customer ?c ; ex:totalprice ?t FILTER(?t > 400000) } }', "c"),
    f"SELECT {CUSTOMER} AS c FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
add(
    "sparql_distinct",
    asked("orders customer", "SELECT DISTINCT ?s ?p WHERE { ?o ex:customer ?c ; ex:priority ?p . ?c ex:segment ?s }", "s", "p"),
    f"SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS p FROM {BOTH}",
)
add(
    "sparql_cross",
    asked("region nation", "SELECT ?r ?n WHERE { ?r ex:r_name ?x . ?n ex:n_name ?y FILTER(STRLEN(?x) < STRLEN(?y)) }", "r", "n"),
    f"SELECT {i('region', 'r_regionkey')} AS r, {i('nation', 'n_nationkey')} AS n FROM region, nation WHERE length(r_name) < length(n_name)",
)
add(
    "sparql_join_groups",
    asked("orders customer", 'SELECT ?o ?s WHERE { { ?o ex:customer ?c ; ex:totalprice ?t FILTER(?t > 300000) } { ?c ex:segment ?s FILTER(?s != "BUILDING") } }', "o", "s"),
    f"SELECT {ORDER} AS o, c_mktsegment AS s FROM {BOTH} WHERE o_totalprice > 300000 AND c_mktsegment <> 'BUILDING'",
)
add(
    "sparql_subselect",
    asked("orders customer", "SELECT ?c ?n WHERE { ?c ex:segment \"BUILDING\" { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:customer ?c } GROUP BY ?c } }", "c", "n"),
    f"SELECT {CUSTOMER} AS c, CAST(count(*) AS VARCHAR) AS n FROM {BOTH} WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey",
)
add(
    "sparql_lateral",
    asked("orders customer", "SELECT ?c ?o WHERE { ?c ex:segment \"BUILDING\" LATERAL { SELECT ?c ?o WHERE { ?o ex:customer ?c ; ex:totalprice ?t } ORDER BY ?t ?o LIMIT 1 } }", "c", "o"),
    f"SELECT {CUSTOMER} AS c, {ORDER} AS o FROM {BOTH} WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice, {ORDER}) = 1",
)
add(
    "sparql_bind",
    asked("orders", "SELECT ?o ?k WHERE { ?o ex:totalprice ?t BIND(FLOOR(?t / 1000) AS ?k) FILTER(?k >= 440) }", "o", "k"),
    f"SELECT {ORDER} AS o, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS k FROM orders WHERE floor(o_totalprice / 1000) >= 440",
)
add(
    "sparql_aggregates",
    asked(
        "orders customer",
        "SELECT ?s (COUNT(*) AS ?n) (COUNT(DISTINCT ?p) AS ?d) (MIN(?k) AS ?low) (MAX(?k) AS ?high) (SUM(?one) AS ?sum) (AVG(?one) AS ?avg) (SAMPLE(?s) AS ?some) (GROUP_CONCAT(DISTINCT ?p ; SEPARATOR=\"|\") AS ?all)"
        " WHERE { ?o ex:customer ?c ; ex:priority ?p ; ex:totalprice ?t . ?c ex:segment ?s BIND(FLOOR(?t) AS ?k) BIND(2 AS ?one) } GROUP BY ?s",
        "s", "n", "d", "low", "high", "sum", "avg", "some", "all",
    ),
    "SELECT c_mktsegment AS s, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT o_orderpriority) AS VARCHAR) AS d, CAST(CAST(min(floor(o_totalprice)) AS BIGINT) AS VARCHAR) AS low, "
    "CAST(CAST(max(floor(o_totalprice)) AS BIGINT) AS VARCHAR) AS high, CAST(2 * count(*) AS VARCHAR) AS sum, '2' AS avg, c_mktsegment AS some, "
    f"string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS all FROM {BOTH} GROUP BY 1",
)
add(
    "sparql_count_all",
    asked("orders", "SELECT (COUNT(?o) AS ?n) (SUM(?t) AS ?sum) (MAX(?t) AS ?most) WHERE { ?o ex:status \"none\" ; ex:totalprice ?t }", "n", "sum", "most"),
    "SELECT '0' AS n, '0' AS sum, CAST(NULL AS VARCHAR) AS most",
)
add(
    "sparql_ask",
    lambda spark, d: run_query(Dataset(mapped(spark, d, "orders")), "ASK { ?o ex:totalprice ?t FILTER(?t > 500000) }", {"ex": EX}),
    "SELECT count(*) > 0 AS ask FROM orders WHERE o_totalprice > 500000",
)


def triples_of(tables: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    """The triples of a CONSTRUCT or DESCRIBE as texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_query(Dataset(mapped(spark, sf_dir, *tables.split())), query, {"ex": EX})
        return out.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))

    return run


add(
    "sparql_construct",
    triples_of("customer nation", "CONSTRUCT { ?n ex:home ?c ; ex:called ?x } WHERE { ?c ex:nation ?n ; ex:acctbal ?b . ?n ex:n_name ?x FILTER(?b > 9500) }"),
    f"SELECT {i('nation', 'n_nationkey')} AS s, '{EX}home' AS p, {CUSTOMER} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 UNION "
    f"SELECT {i('nation', 'n_nationkey')}, '{EX}called', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500",
)
add(
    "sparql_describe",
    triples_of("nation region", "DESCRIBE ?n { ?n ex:region <http://example.org/region/1> }"),
    f"SELECT {i('nation', 'n_nationkey')} AS s, '{EX}n_name' AS p, n_name AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {i('nation', 'n_nationkey')}, '{EX}region', '{EX}region/1' FROM nation WHERE n_regionkey = 1 "
    f"UNION ALL SELECT {i('nation', 'n_nationkey')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{EX}Nation' FROM nation WHERE n_regionkey = 1",
)
add(
    "sparql_variable_predicate",
    asked("orders", "SELECT ?p (COUNT(?o) AS ?n) WHERE { ?o ex:status \"P\" ; ?p ?v } GROUP BY ?p", "p", "n"),
    "SELECT unnest(["
    + ", ".join(f"'{EX}{p}'" for p in ("customer", "status", "priority", "totalprice", "orderdate", "selfkey", "custkey"))
    + ", 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p, n FROM (SELECT CAST(count(*) AS VARCHAR) AS n FROM orders WHERE o_orderstatus = 'P') WHERE n <> '0'",
)
add(
    "sparql_negated_path",
    asked("nation region", "SELECT ?n ?x WHERE { ?n !(ex:n_name|a) ?x }", "n", "x"),
    f"SELECT {i('nation', 'n_nationkey')} AS n, {i('region', 'n_regionkey')} AS x FROM nation UNION ALL SELECT {i('region', 'r_regionkey')}, r_name FROM region",
)
add(
    "sparql_closure_path",
    asked("conversations", "SELECT ?a ?b WHERE { ?a ex:role \"system\" ; ex:next+ ?b }", "a", "b"),
    f"WITH RECURSIVE e AS (SELECT concat(conv_id, '-', turn) AS s, concat(conv_id, '-', turn + 1) AS o, role FROM conversations), w(s, o) AS (SELECT s, o FROM e WHERE role = 'system' UNION SELECT w.s, e.o FROM w JOIN e ON w.o = e.s) "
    f"SELECT concat('{EX}turn/', s) AS a, concat('{EX}turn/', o) AS b FROM w",
)
add(
    "sparql_text_functions",
    asked(
        "part",
        "SELECT ?p ?a ?b ?c ?d ?e ?f ?g WHERE { ?p ex:p_name ?x ; ex:brand ?y BIND(UCASE(?x) AS ?a) BIND(SUBSTR(?x, 2, 4) AS ?b) BIND(STRBEFORE(?x, \" \") AS ?c) BIND(STRAFTER(?x, \" \") AS ?d)"
        " BIND(CONCAT(?x, \"-\", ?y) AS ?e) BIND(REPLACE(?x, \"[aeiou]\", \"_\") AS ?f) BIND(IF(STRSTARTS(?x, \"s\") && CONTAINS(?x, \"e\"), STRLEN(?x), 0) AS ?g) FILTER(REGEX(?x, \"N\", \"i\") && !STRENDS(?y, \"1\")) }",
        "p", "a", "b", "c", "d", "e", "f", "g",
    ),
    f"SELECT {i('part', 'p_partkey')} AS p, upper(p_name) AS a, substr(p_name, 2, 4) AS b, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS c, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS d, "
    "concat(p_name, '-', p_brand) AS e, regexp_replace(p_name, '[aeiou]', '_', 'g') AS f, CAST(CASE WHEN p_name LIKE 's%' AND p_name LIKE '%e%' THEN length(p_name) ELSE 0 END AS VARCHAR) AS g "
    "FROM part WHERE regexp_matches(p_name, '(?i)N') AND NOT p_brand LIKE '%1'",
)
add(
    "sparql_number_functions",
    asked(
        "customer",
        "SELECT ?c ?a ?b ?d ?e ?f WHERE { ?c ex:acctbal ?x BIND(CEIL(ABS(?x)) AS ?a) BIND(FLOOR(?x) AS ?b) BIND(ROUND(?x) AS ?d) BIND(xsd:integer(ABS(?x)) + 1 AS ?e) BIND(ISNUMERIC(?x) && DATATYPE(?x) = xsd:double AS ?f) FILTER(?x / 2 - 1 < 0 || ?x IN (1, 2)) }",
        "c", "a", "b", "d", "e", "f",
    ),
    f"SELECT {CUSTOMER} AS c, CAST(CAST(ceil(abs(c_acctbal)) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS b, CAST(CAST(floor(c_acctbal + 0.5) AS BIGINT) AS VARCHAR) AS d, "
    "CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) + 1 AS VARCHAR) AS e, 'true' AS f FROM customer WHERE c_acctbal / 2 - 1 < 0 OR c_acctbal IN (1, 2)",
)
add(
    "sparql_time_functions",
    asked("orders", "SELECT ?y ?m ?d (COUNT(?o) AS ?n) WHERE { ?o ex:orderdate ?t } GROUP BY (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d)", "y", "m", "d", "n"),
    "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1, 2, 3",
)
add(
    "sparql_term_functions",
    asked(
        "nation",
        "SELECT ?n ?a ?b ?c ?d WHERE { ?n ex:n_name ?x ; ex:region ?r BIND(MD5(?x) AS ?a) BIND(SHA256(STR(?r)) AS ?b) BIND(LANG(STRLANG(?x, \"EN\")) AS ?c) BIND(COALESCE(?none, IRI(CONCAT(STR(?n), \"#\"))) AS ?d)"
        " FILTER(ISIRI(?r) && ISLITERAL(?x) && !ISBLANK(?n) && !SAMETERM(?n, ?r) && LANGMATCHES(LANG(STRLANG(?x, \"en-GB\")), \"en\") && !BOUND(?none)) }",
        "n", "a", "b", "c", "d",
    ),
    f"SELECT {i('nation', 'n_nationkey')} AS n, md5(n_name) AS a, sha256({i('region', 'n_regionkey')}) AS b, 'en' AS c, concat({i('nation', 'n_nationkey')}, '#') AS d FROM nation",
)
