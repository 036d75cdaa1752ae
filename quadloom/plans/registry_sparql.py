"""More named SPARQL queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators.store import QuadStore
from quadloom.plans.compiler import Compiler, Graphs, to_native
from quadloom.plans.parser import has_graph_scope, parse_query, scoped_text
from quadloom.plans.registry import PREFIXES, _table, register, sparql
from quadloom.sources.mapping import BASE, quad, shop, uri

X = "http://www.w3.org/2001/XMLSchema#"
_TRIM = r"regexp_replace(regexp_replace(CAST({} AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')"

sparql(
    "sparql_exists_correlated",
    ["customer"],
    "SELECT ?c ?b WHERE { ?c :nation ?n ; :c_acctbal ?b FILTER NOT EXISTS { ?d :nation ?n ; :c_acctbal ?e FILTER(?e > ?b) } }",
    {"c": "string", "b": "double"},
    "SELECT 'urn:customer:' || c_custkey AS c, c_acctbal AS b FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = a.c_nationkey AND x.c_acctbal > a.c_acctbal)",
)
sparql(
    "sparql_exists_unshared",
    ["nation", "region"],
    "SELECT ?name WHERE { ?r :r_name ?name FILTER EXISTS { ?n :n_name ?other FILTER(STRSTARTS(?other, SUBSTR(?name, 1, 2))) } }",
    {"name": "string"},
    "SELECT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE starts_with(n_name, substr(r_name, 1, 2)))",
)
sparql(
    "sparql_exists_or",
    ["customer", "orders"],
    'SELECT ?c WHERE { ?c :c_acctbal ?b FILTER(EXISTS { ?o :placedBy ?c ; :o_orderstatus "F" } && ?b < 1000 || ?b > 9000 && NOT EXISTS { ?p :placedBy ?c ; :o_totalprice ?t FILTER(?t > ?b * 10) }) }',
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE (c_acctbal < 1000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) OR (c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 10))",
)
sparql(
    "sparql_distinct_order",
    ["customer"],
    "SELECT DISTINCT ?n WHERE { ?c :nation ?n ; :c_acctbal ?b } ORDER BY DESC(?b) LIMIT 4",
    {"n": "string"},
    "SELECT 'urn:nation:' || c_nationkey AS n FROM customer GROUP BY c_nationkey ORDER BY max(c_acctbal) DESC LIMIT 4",
)
sparql(
    "sparql_decimal_sum",
    ["customer"],
    f"SELECT ?n (SUM(?d) AS ?total) (COUNT(?d) AS ?k) (SUM(DISTINCT ?d) AS ?once) WHERE {{ ?c :nation ?n ; :c_acctbal ?b BIND(<{X}decimal>(STR(?b)) AS ?d) }} GROUP BY ?n",
    {"n": "string", "total": "string", "k": "bigint", "once": "string"},
    f"SELECT 'urn:nation:' || c_nationkey AS n, {_TRIM.format('sum(CAST(c_acctbal AS DECIMAL(20,6)))')} AS total, count(*) AS k, {_TRIM.format('sum(DISTINCT CAST(c_acctbal AS DECIMAL(20,6)))')} AS once FROM customer GROUP BY c_nationkey",
)
sparql(
    "sparql_big_integers",
    ["nation"],
    f"SELECT ?n ?x ?y WHERE {{ ?r :n_name ?n BIND(<{X}integer>(STRLEN(?n)) + 9007199254740992 AS ?x) BIND(?x * 3 AS ?y) FILTER(?x != 9007199254740999 && ?x > 9007199254740997) }}",
    {"n": "string", "x": "string", "y": "string"},
    "SELECT n_name AS n, CAST(length(n_name) + 9007199254740992 AS VARCHAR) AS x, CAST((length(n_name) + 9007199254740992) * 3 AS VARCHAR) AS y FROM nation WHERE length(n_name) <> 7 AND length(n_name) > 5",
)
sparql(
    "sparql_time_fields",
    ["events"],
    "SELECT ?e ?y ?mo ?d ?h ?mi ?s WHERE { ?e :ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?mo) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(SECONDS(?t) AS ?s) }",
    {"e": "string", "y": "bigint", "mo": "bigint", "d": "bigint", "h": "bigint", "mi": "bigint", "s": "bigint"},
    "SELECT 'urn:event:' || event_id AS e, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events",
)
_ZONED = f'VALUES ?t {{ "2011-01-10T14:45:13.815-05:30"^^<{X}dateTime> "2011-01-10T14:45:13Z"^^<{X}dateTime> "2011-01-10T04:05:06"^^<{X}dateTime> "2011-12-31"^^<{X}date> "none" }}'
sparql(
    "sparql_time_zones",
    ["region"],
    f"SELECT ?t ?y ?h ?mi ?s ?z ?o WHERE {{ {_ZONED} BIND(YEAR(?t) AS ?y) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(SECONDS(?t) AS ?s) BIND(TZ(?t) AS ?z) BIND(STR(TIMEZONE(?t)) AS ?o) }}",
    {"t": "string", "y": "bigint", "h": "bigint", "mi": "bigint", "s": "double", "z": "string", "o": "string"},
    "SELECT * FROM (VALUES ('2011-01-10T14:45:13.815-05:30', CAST(2011 AS BIGINT), CAST(14 AS BIGINT), CAST(45 AS BIGINT), CAST(13.815 AS DOUBLE), '-05:30', '-PT5H30M'), ('2011-01-10T14:45:13Z', 2011, 14, 45, 13, 'Z', 'PT0S'), ('2011-01-10T04:05:06', 2011, 4, 5, 6, '', NULL), ('2011-12-31', 2011, NULL, NULL, NULL, '', NULL), ('none', NULL, NULL, NULL, NULL, NULL, NULL)) v(t, y, h, mi, s, z, o)",
)
sparql(
    "sparql_functions_text",
    ["customer"],
    'SELECT ?c ?lo ?sub ?tail ?before ?r ?j ?enc ?md ?sha ?sha1 ?starts ?ends ?re WHERE { ?c :c_name ?n ; :c_mktsegment ?m BIND(LCASE(?n) AS ?lo) BIND(SUBSTR(?n, 3, 4) AS ?sub) BIND(SUBSTR(?n, 5) AS ?tail) BIND(STRBEFORE(?n, "#") AS ?before) BIND(REPLACE(?m, "[AEIOU]", "*") AS ?r) BIND(CONCAT(?m, "-", ?n) AS ?j) BIND(ENCODE_FOR_URI(?n) AS ?enc) BIND(MD5(?n) AS ?md) BIND(SHA256(?n) AS ?sha) BIND(SHA1(?n) AS ?sha1) BIND(STRSTARTS(?m, "B") AS ?starts) BIND(STRENDS(?m, "E") AS ?ends) BIND(REGEX(?m, "^a", "i") AS ?re) }',
    {x: "boolean" if x in ("starts", "ends", "re") else "string" for x in ("c", "lo", "sub", "tail", "before", "r", "j", "enc", "md", "sha", "sha1", "starts", "ends", "re")},
    "SELECT 'urn:customer:' || c_custkey AS c, lower(c_name) AS lo, substr(c_name, 3, 4) AS sub, substr(c_name, 5) AS tail, CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, 1, strpos(c_name, '#') - 1) ELSE '' END AS before, regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g') AS r, c_mktsegment || '-' || c_name AS j, url_encode(c_name) AS enc, md5(c_name) AS md, sha256(c_name) AS sha, sha1(c_name) AS sha1, starts_with(c_mktsegment, 'B') AS starts, ends_with(c_mktsegment, 'E') AS ends, regexp_matches(c_mktsegment, '^a', 'i') AS re FROM customer",
)
sparql(
    "sparql_functions_numeric",
    ["customer"],
    f'SELECT ?c ?a ?up ?down ?r ?sum ?diff ?times ?part ?sign ?whole ?co WHERE {{ ?c :c_acctbal ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?up) BIND(FLOOR(?b) AS ?down) BIND(ROUND(?b) AS ?r) BIND(?b + 1 AS ?sum) BIND(?b - 0.5 AS ?diff) BIND(?b * 2 AS ?times) BIND(?b / 4 AS ?part) BIND(IF(?b < 0, "minus", "plus") AS ?sign) BIND(<{X}integer>(?b) AS ?whole) BIND(COALESCE(?missing, 1 / 0, ?b) AS ?co) }}',
    {"c": "string", "a": "double", "up": "double", "down": "double", "r": "double", "sum": "double", "diff": "double", "times": "double", "part": "double", "sign": "string", "whole": "bigint", "co": "double"},
    "SELECT 'urn:customer:' || c_custkey AS c, abs(b) AS a, ceil(b) AS up, floor(b) AS down, floor(b + 0.5) AS r, b + 1 AS sum, b - 0.5 AS diff, b * 2 AS times, b / 4 AS part, CASE WHEN b < 0 THEN 'minus' ELSE 'plus' END AS sign, CAST(trunc(b) AS BIGINT) AS whole, b AS co FROM (SELECT c_custkey, c_acctbal AS b FROM customer)",
)
_TERMS = f'VALUES (?id ?t) {{ ("iri" <http://e.org/a#b>) ("plain" "x") ("lang" "x"@EN-gb) ("int" 7) ("dec" 1.50) ("date" "2020-02-03"^^<{X}date>) ("bad" "x"^^<{X}integer>) ("none" UNDEF) }}'
sparql(
    "sparql_functions_terms",
    ["region"],
    f'SELECT ?id ?s ?dt ?l ?en ?iri ?lit ?num ?bound ?made ?tagged ?same ?blank WHERE {{ {_TERMS} BIND(STR(?t) AS ?s) BIND(STR(DATATYPE(?t)) AS ?dt) BIND(LANG(?t) AS ?l) BIND(LANGMATCHES(LANG(?t), "en") AS ?en) BIND(isIRI(?t) AS ?iri) BIND(isLITERAL(?t) AS ?lit) BIND(isNUMERIC(?t) AS ?num) BIND(BOUND(?t) AS ?bound) BIND(DATATYPE(STRDT("1", <{X}int>)) = <{X}int> AS ?made) BIND(LANG(STRLANG("a", "fr")) AS ?tagged) BIND(SAMETERM(?t, 7) AS ?same) BIND(isBLANK(?t) AS ?blank) }}',
    {x: "boolean" if x in ("en", "iri", "lit", "num", "bound", "made", "same", "blank") else "string" for x in ("id", "s", "dt", "l", "en", "iri", "lit", "num", "bound", "made", "tagged", "same", "blank")},
    f"""SELECT id, s, dt, l, en, iri, lit, num, bound, true AS made, 'fr' AS tagged, same, blank FROM (VALUES
    ('iri', 'http://e.org/a#b', NULL, NULL, NULL, true, false, false, true, false, false), ('plain', 'x', '{X}string', '', false, false, true, false, true, false, false),
    ('lang', 'x', '{T.LANG_STRING}', 'en-gb', true, false, true, false, true, false, false), ('int', '7', '{X}integer', '', false, false, true, true, true, true, false),
    ('dec', '1.50', '{X}decimal', '', false, false, true, true, true, false, false), ('date', '2020-02-03', '{X}date', '', false, false, true, false, true, false, false),
    ('bad', 'x', '{X}integer', '', false, false, true, false, true, false, false), ('none', NULL, NULL, NULL, NULL, NULL, NULL, false, false, NULL, NULL)) v(id, s, dt, l, en, iri, lit, num, bound, same, blank)""",
)
sparql(
    "sparql_in_typed",
    ["part"],
    f'SELECT ?p WHERE {{ ?p :p_size ?s ; :p_brand ?b FILTER(?s IN (3, 7.0, "9"^^<{X}integer>)) FILTER(?b = "Brand#11"^^<{X}string> || ?b != "Brand#1") }}',
    {"p": "string"},
    "SELECT 'urn:part:' || p_partkey AS p FROM part WHERE p_size IN (3, 7, 9) AND (p_brand = 'Brand#11' OR p_brand <> 'Brand#1')",
)
sparql(
    "sparql_typed_constant",
    ["part"],
    f'SELECT ?p ?n WHERE {{ ?p :p_size "7"^^<{X}integer> ; :p_name ?n . }}',
    {"p": "string", "n": "string"},
    "SELECT 'urn:part:' || p_partkey AS p, p_name AS n FROM part WHERE p_size = 7",
)
sparql(
    "sparql_cross_product",
    ["region"],
    "SELECT REDUCED ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b }",
    {"a": "string", "b": "string"},
    "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y",
)
sparql(
    "sparql_star_projection",
    ["nation"],
    "SELECT * WHERE { ?n :n_name ?name ; :region ?r }",
    {"n": "string", "name": "string", "r": "string"},
    "SELECT 'urn:nation:' || n_nationkey AS n, n_name AS name, 'urn:region:' || n_regionkey AS r FROM nation",
)
sparql(
    "sparql_path_star",
    ["supplier", "nation"],
    "SELECT ?s ?where WHERE { ?s :s_name ?name ; (:nation|:region)* ?where }",
    {"s": "string", "where": "string"},
    "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS \"where\" FROM supplier UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:supplier:' || s_suppkey FROM supplier",
)
sparql(
    "sparql_path_maybe",
    ["customer", "nation"],
    "SELECT ?c ?x WHERE { ?c a :Customer ; :nation/:region? ?x }",
    {"c": "string", "x": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || c_nationkey AS x FROM customer UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "sparql_path_to_bound_end",
    ["customer", "nation", "region"],
    'SELECT ?c WHERE { ?r :r_name "ASIA" . ?c (:nation|:region)+ ?r . ?c a :Customer }',
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
sparql(
    "sparql_aggregates_more",
    ["part", "documents"],
    "SELECT ?l (AVG(DISTINCT ?n) AS ?mean) (COUNT(DISTINCT *) AS ?all) (MIN(?s) AS ?low) (MAX(?s) AS ?high) (SAMPLE(?l) AS ?some) WHERE { ?d :lang ?l ; :source ?s ; :n_chars ?n } GROUP BY ?l",
    {"l": "string", "mean": "double", "all": "bigint", "low": "string", "high": "string", "some": "string"},
    "SELECT lang AS l, avg(DISTINCT n_chars) AS mean, count(*) AS all, min(source) AS low, max(source) AS high, lang AS some FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL GROUP BY lang",
)
sparql(
    "sparql_aggregate_of_nothing",
    ["region"],
    'SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?s) (AVG(?x) AS ?a) (MIN(?x) AS ?m) WHERE { ?r :r_name "NOWHERE" ; :r_name ?x }',
    {"n": "bigint", "s": "bigint", "a": "double", "m": "string"},
    "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS a, CAST(NULL AS VARCHAR) AS m",
)
sparql(
    "sparql_group_expression",
    ["orders"],
    "SELECT ?y (COUNT(*) AS ?n) (SUM(?p) AS ?total) WHERE { ?o :o_orderdate ?d ; :o_totalprice ?p } GROUP BY (YEAR(?d) AS ?y) HAVING(SUM(?p) > 100 && COUNT(*) >= 1)",
    {"y": "bigint", "n": "bigint", "total": "double"},
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 100",
)
sparql(
    "sparql_optional_nested",
    ["customer", "orders", "nation"],
    'SELECT ?c ?o ?n WHERE { ?c a :Customer OPTIONAL { ?o :placedBy ?c ; :o_orderstatus "P" } OPTIONAL { ?c :nation ?x . ?x :n_name ?n FILTER(STRLEN(?n) > 7 && BOUND(?o)) } }',
    {"c": "string", "o": "string", "n": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c, 'urn:order:' || o_orderkey AS o, CASE WHEN o_orderkey IS NOT NULL AND length(n_name) > 7 THEN n_name END AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' JOIN nation ON n_nationkey = c_nationkey",
)
sparql(
    "sparql_compatible_join",
    ["documents", "labels"],
    "SELECT ?d ?q WHERE { ?d :lang ?l OPTIONAL { ?d :toxic ?q FILTER(?q = 1) } { SELECT ?q WHERE { VALUES ?q { 1 5 } } } }",
    {"d": "string", "q": "bigint"},
    "SELECT 'urn:doc:' || d.doc_id AS d, CAST(v.q AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 JOIN (VALUES (1), (5)) v(q) ON l.toxic IS NULL OR l.toxic = v.q WHERE lang IS NOT NULL",
)


def _knows(spark: SparkSession, sf_dir: str, g: str = "") -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return n.select(*quad(g, uri("n", F.col("n_nationkey")), BASE + "knows", T.IRI, uri("n", F.col("n_nationkey") % 7)))


def _registered(name: str, text: str, kinds: dict[str, str], sql: str, data) -> None:
    """A SPARQL query over quads that data() makes."""

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_native(Compiler(data(spark, sf_dir)).select(parse_query(text, PREFIXES)), kinds)


_registered("sparql_repeated_variable", "SELECT ?x WHERE { ?x :knows ?x }", {"x": "string"}, "SELECT 'urn:n:' || n_nationkey AS x FROM nation WHERE n_nationkey = n_nationkey % 7", _knows)
_registered(
    "sparql_variable_predicate",
    "SELECT ?p (COUNT(*) AS ?n) (COUNT(DISTINCT ?o) AS ?k) WHERE { ?s ?p ?o } GROUP BY ?p",
    {"p": "string", "n": "bigint", "k": "bigint"},
    f"SELECT '{BASE}knows' AS p, count(*) AS n, count(DISTINCT n_nationkey % 7) AS k FROM nation UNION ALL SELECT '{BASE}r_name', count(*), count(DISTINCT r_name) FROM region UNION ALL SELECT '{T.RDF}type', count(*), 1 FROM region",
    lambda spark, d: _knows(spark, d).unionByName(shop(spark, d, ["region"])),
)
_GRAPHS = lambda spark, d: shop(spark, d, ["nation"], "urn:g:nation").unionByName(shop(spark, d, ["region"], "urn:g:region")).unionByName(_knows(spark, d, ""))
_registered(
    "sparql_graph_iri",
    "SELECT ?name ?r WHERE { GRAPH <urn:g:nation> { ?n :n_name ?name ; :region ?x } GRAPH <urn:g:region> { ?x :r_name ?r } }",
    {"name": "string", "r": "string"},
    "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    _GRAPHS,
)
_registered(
    "sparql_graph_variable",
    "SELECT ?g ?p (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x ?p ?y FILTER(?p != <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) } } GROUP BY ?g ?p",
    {"g": "string", "p": "string", "n": "bigint"},
    f"SELECT 'urn:g:nation' AS g, '{BASE}' || p AS p, count(*) AS n FROM nation, (VALUES ('n_name'), ('region')) v(p) GROUP BY p UNION ALL SELECT 'urn:g:region', '{BASE}r_name', count(*) FROM region",
    _GRAPHS,
)
_registered(
    "sparql_from_named",
    "SELECT ?name ?r FROM <urn:g:nation> FROM NAMED <urn:g:region> WHERE { ?n :n_name ?name ; :region ?x GRAPH ?g { ?x :r_name ?r } }",
    {"name": "string", "r": "string"},
    "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    _GRAPHS,
)
_registered(
    "sparql_from_merges",
    "SELECT ?x ?r FROM <urn:g:nation> FROM <urn:g:region> WHERE { ?n :region ?x . ?x :r_name ?r FILTER NOT EXISTS { ?n :knows ?y } }",
    {"x": "string", "r": "string"},
    "SELECT 'urn:region:' || r_regionkey AS x, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    _GRAPHS,
)
_registered(
    "sparql_path_in_graph",
    "SELECT ?a ?b WHERE { ?a :knows+ ?b }",
    {"a": "string", "b": "string"},
    "SELECT 'urn:n:' || n_nationkey AS a, 'urn:n:' || n_nationkey % 7 AS b FROM nation",
    lambda spark, d: _knows(spark, d),
)


@register("sparql_order_of_terms", "SELECT * FROM (VALUES (0, CAST(NULL AS VARCHAR)), (1, 'http://a/'), (2, 'http://b/'), (3, '9'), (4, '10'), (5, '10.5'), (6, '2019-01-01'), (7, '2020-01-01'), (8, 'a'), (9, 'b')) v(place, x)")
def sparql_order_of_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbound, IRIs, then literals: numbers and times by value."""
    text = f'SELECT ?x WHERE {{ VALUES ?x {{ "b" 10.5 <http://b/> "2020-01-01"^^<{X}date> 9 UNDEF "a" 10 <http://a/> "2019-01-01"^^<{X}date> }} }} ORDER BY ?x'
    rows = [r.x.lex if r.x else None for r in Compiler(shop(spark, sf_dir, ["region"])).select(parse_query(text)).df.collect()]
    numbers, times, texts = [x for x in rows if x in ("9", "10", "10.5")], [x for x in rows if x and x.startswith("20")], [x for x in rows if x in ("a", "b")]
    kept = rows[:3] + numbers + times + texts  # the order among kinds of literals is the engine's own
    return spark.createDataFrame(list(enumerate(kept)), "place int, x string")


@register("sparql_ask", "SELECT * FROM (VALUES ('asia', true), ('atlantis', false), ('not exists', true)) v(question, answer)")
def sparql_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Compiler(shop(spark, sf_dir, ["region", "nation"]))
    questions = {"asia": 'ASK { ?r :r_name "ASIA" }', "atlantis": 'ASK { ?r :r_name "ATLANTIS" }', "not exists": "ASK { ?r a :Region FILTER NOT EXISTS { ?r :region ?x } }"}
    return spark.createDataFrame([(k, c.ask(parse_query(q, PREFIXES))) for k, q in questions.items()], "question string, answer boolean")


@register("sparql_scope", "SELECT * FROM (VALUES ('graph', true, 25, true), ('from', true, 0, true), ('from named', true, 0, true), ('none', false, 25, true), ('raw', false, 0, true), ('no body', false, NULL, false)) v(query, names_graphs, found, has_text)")
def sparql_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a graph of their own are put into one; as a tree and as text."""
    store = QuadStore(spark, shop(spark, sf_dir, ["nation"], "urn:g:nation"), prefixes=PREFIXES)
    texts = {
        "graph": "SELECT ?n WHERE { GRAPH <urn:g:nation> { ?n :n_name ?x } }",
        "from": "SELECT ?n FROM <urn:g:none> WHERE { ?n :n_name ?x }",
        "from named": "SELECT ?n FROM NAMED <urn:g:nation> WHERE { ?n :n_name ?x }",
        "none": 'SELECT ?n { ?n :n_name ?x FILTER(?x != "}") }',
        "raw": "SELECT ?n WHERE { ?n :n_name ?x }",
    }
    rows = []
    for name, text in texts.items():
        own, scoped = has_graph_scope(parse_query(text, PREFIXES)), scoped_text(text, "urn:g:nation")
        found = store.query(text, None if name == "raw" else "urn:g:nation", raw=name == "raw").df.count()
        same = own or store.query(scoped).df.count() == (25 if name in ("none", "raw") else found)
        rows.append((name, own, found, scoped is not None and same))
    rows.append(("no body", has_graph_scope(parse_query("DESCRIBE <urn:nation:1>")), None, scoped_text("DESCRIBE <urn:nation:1>", "urn:g:nation") is not None))
    return spark.createDataFrame(rows, "query string, names_graphs boolean, found int, has_text boolean")


@register("sparql_mapped_graph", "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 5")
def sparql_mapped_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped tables under a graph's name, scanned as they are."""
    from quadloom.sources.mapping import mapped

    g, tables = "urn:g:shop", ["nation", "region"]
    c = Compiler(shop(spark, sf_dir, tables, g), Graphs(one=g), mapped(spark, sf_dir, tables, g))
    found = c.select(parse_query("SELECT ?name ?r WHERE { ?n :n_name ?name ; :region ?x . ?x :r_name ?r FILTER(?n NOT IN (<urn:nation:0>, <urn:nation:1>, <urn:nation:2>, <urn:nation:3>, <urn:nation:4>)) }", PREFIXES))
    return to_native(found, {"name": "string", "r": "string"})


# --- EXISTS that uses the row at any depth; joins on what may be unbound; closing paths in every graph

sparql(
    "sparql_exists_in_optional",
    ["customer", "orders"],
    "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { ?o :placedBy ?c OPTIONAL { ?o :o_totalprice ?t FILTER(?t < ?b * 10) } FILTER(BOUND(?t)) } }",
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal * 10)",
)
sparql(
    "sparql_exists_in_exists",
    ["customer", "orders"],
    "SELECT ?c WHERE { ?c :nation ?n ; :c_acctbal ?b FILTER(?b > 9000) FILTER NOT EXISTS { ?d :nation ?n ; :c_mktsegment ?m FILTER EXISTS { ?o :placedBy ?d ; :o_totalprice ?t FILTER(?t > ?b * 50) } } }",
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer a WHERE c_acctbal > 9000 AND NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = a.c_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = d.c_custkey AND o_totalprice > a.c_acctbal * 50))",
)
sparql(
    "sparql_exists_in_union",
    ["customer", "nation", "orders"],
    'SELECT ?c WHERE { ?c :nation ?n ; :c_acctbal ?b FILTER EXISTS { { ?n :n_name ?x FILTER(?b < 0) } UNION { ?o :placedBy ?c ; :o_orderstatus "F" FILTER(?b > 8000) } } }',
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_acctbal < 0 OR c_acctbal > 8000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
sparql(
    "sparql_exists_in_minus",
    ["customer", "orders"],
    "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { ?o :placedBy ?c MINUS { ?o :o_totalprice ?t FILTER(?t > ?b * 20) } } }",
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > c_acctbal * 20)",
)
_BOTH = """(SELECT d.doc_id, d.source, CAST(l.quality AS BIGINT) AS q, CAST(l.toxic AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
sparql(
    "sparql_join_perhaps_unbound",
    ["documents", "labels"],
    "SELECT ?d ?v WHERE { { ?d :source ?s OPTIONAL { ?d :quality ?v FILTER(?v = 1) } } { ?d :lang ?l OPTIONAL { ?d :toxic ?v FILTER(?v = 1) } } }",
    {"d": "string", "v": "bigint"},
    f"SELECT 'urn:doc:' || doc_id AS d, CASE WHEN q = 1 OR t = 1 THEN 1 END AS v FROM {_BOTH}",
)
sparql(
    "sparql_optional_perhaps_unbound",
    ["documents", "labels"],
    "SELECT ?d ?v ?l WHERE { ?d :source ?s OPTIONAL { ?d :quality ?v FILTER(?v = 1) } OPTIONAL { ?d :toxic ?v ; :quality ?l } }",
    {"d": "string", "v": "bigint", "l": "bigint"},
    f"SELECT 'urn:doc:' || doc_id AS d, CASE WHEN q = 1 THEN 1 ELSE t END AS v, CASE WHEN q = 1 AND t <> 1 THEN NULL ELSE q END AS l FROM {_BOTH}",
)
sparql(
    "sparql_minus_perhaps_unbound",
    ["documents", "labels"],
    "SELECT ?d ?v WHERE { ?d :source ?s OPTIONAL { ?d :quality ?v } MINUS { ?x :toxic 1 OPTIONAL { ?x :quality ?v FILTER(?v = 0) } } }",
    {"d": "string", "v": "bigint"},
    f"SELECT 'urn:doc:' || doc_id AS d, q AS v FROM {_BOTH} WHERE q IS NULL OR NOT (q = 0 AND EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND quality = 0))",
)


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer, each followed by its next one; a graph for each order priority of the earlier one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    after = orders.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("b")).filter("b is not null")
    return after.select(*quad("", uri("order", F.col("a")), BASE + "next", T.IRI, uri("order", F.col("b"))), "o_orderpriority").withColumn("g", F.concat(F.lit("urn:priority:"), F.substring("o_orderpriority", 1, 1))).drop("o_orderpriority")


_registered(
    "sparql_path_graph_variable",
    "SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :next+ ?y } }",
    {"g": "string", "x": "string", "y": "string"},
    """WITH RECURSIVE e AS (
      SELECT * FROM (SELECT 'urn:priority:' || substr(o_orderpriority, 1, 1) AS g, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL
    ), r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.b)
    SELECT g, 'urn:order:' || a AS x, 'urn:order:' || b AS y FROM r""",
    _chains,
)
_registered(
    "sparql_path_graph_variable_bound",
    'SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x :next ?z . ?z :next* ?y FILTER(STRENDS(STR(?x), "7")) } }',
    {"g": "string", "x": "string", "y": "string"},
    """WITH RECURSIVE e AS (
      SELECT * FROM (SELECT 'urn:priority:' || substr(o_orderpriority, 1, 1) AS g, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL
    ), r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.b)
    SELECT g, 'urn:order:' || a AS x, 'urn:order:' || b AS y FROM r WHERE a % 10 = 7""",
    _chains,
)
