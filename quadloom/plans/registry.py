"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.plans.compiler import Compiler, to_native
from quadloom.plans.parser import parse_query
from quadloom.sources.mapping import BASE, mapped, shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PREFIXES = {"": BASE}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sparql(name: str, tables: list[str], text: str, kinds: dict[str, str], sql: str) -> None:
    """A SPARQL query over some of the mapped tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        found = Compiler(shop(spark, sf_dir, tables), maps=mapped(spark, sf_dir, tables)).select(parse_query(text, PREFIXES))
        return to_native(found, kinds)

    QUERIES[name], ORACLES[name] = run, sql


sparql(
    "sparql_customers_per_region",
    ["customer", "nation", "region"],
    "SELECT ?region (COUNT(?c) AS ?n) WHERE { ?c a :Customer ; :nation ?na . ?na :region ?r . ?r :r_name ?region } GROUP BY ?region",
    {"region": "string", "n": "bigint"},
    "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
sparql(
    "sparql_star_filter",
    ["part"],
    'SELECT ?name ?brand ?size WHERE { ?p a :Part ; :p_name ?name ; :p_brand ?brand ; :p_size ?size . FILTER(?size > 40 && ?brand != "Brand#1") }',
    {"name": "string", "brand": "string", "size": "bigint"},
    "SELECT p_name AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 40 AND p_brand <> 'Brand#1'",
)
sparql(
    "sparql_optional",
    ["documents", "labels"],
    "SELECT ?d ?source ?q WHERE { ?d :source ?source OPTIONAL { ?d :quality ?q . FILTER(?q = 1) } }",
    {"d": "string", "source": "string", "q": "bigint"},
    "SELECT 'urn:doc:' || d.doc_id AS d, source, CAST(l.quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1",
)
sparql(
    "sparql_minus",
    ["documents", "labels"],
    "SELECT ?d WHERE { ?d a :Doc MINUS { ?d :toxic ?t } }",
    {"d": "string"},
    "SELECT 'urn:doc:' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
sparql(
    "sparql_not_exists",
    ["customer", "orders"],
    'SELECT ?c WHERE { ?c a :Customer FILTER NOT EXISTS { ?o :placedBy ?c ; :o_orderdate ?d FILTER(YEAR(?d) = 1998) } }',
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)",
)
sparql(
    "sparql_exists",
    ["customer", "orders"],
    'SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :placedBy ?c ; :o_orderstatus "F" } }',
    {"c": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
sparql(
    "sparql_union_distinct",
    ["customer", "supplier"],
    "SELECT DISTINCT ?n WHERE { { ?x a :Customer ; :nation ?n } UNION { ?x a :Supplier ; :nation ?n } }",
    {"n": "string"},
    "SELECT 'urn:nation:' || c_nationkey AS n FROM customer UNION SELECT 'urn:nation:' || s_nationkey FROM supplier",
)
sparql(
    "sparql_group_having_order_limit",
    ["orders"],
    "SELECT ?c (COUNT(*) AS ?n) (MAX(?d) AS ?last) WHERE { ?o :placedBy ?c ; :o_orderdate ?d } GROUP BY ?c HAVING(COUNT(*) > 5) ORDER BY DESC(?n) ?c LIMIT 20",
    {"c": "string", "n": "bigint", "last": "string"},
    "SELECT 'urn:customer:' || o_custkey AS c, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS last FROM orders GROUP BY o_custkey HAVING count(*) > 5 ORDER BY n DESC, c LIMIT 20",
)
sparql(
    "sparql_aggregates",
    ["part"],
    "SELECT ?b (SUM(?s) AS ?total) (AVG(?s) AS ?mean) (MIN(?s) AS ?low) (MAX(?s) AS ?high) (COUNT(DISTINCT ?s) AS ?kinds) WHERE { ?p :p_brand ?b ; :p_size ?s } GROUP BY ?b",
    {"b": "string", "total": "bigint", "mean": "double", "low": "bigint", "high": "bigint", "kinds": "bigint"},
    "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS mean, CAST(min(p_size) AS BIGINT) AS low, CAST(max(p_size) AS BIGINT) AS high, count(DISTINCT p_size) AS kinds FROM part GROUP BY p_brand",
)
sparql(
    "sparql_group_concat",
    ["nation", "region"],
    'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?nations) WHERE { ?x :n_name ?n ; :region ?y . ?y :r_name ?r } GROUP BY ?r',
    {"r": "string", "nations": "string"},
    "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
sparql(
    "sparql_bind_functions",
    ["customer"],
    'SELECT ?c ?u ?len ?tail WHERE { ?c :c_name ?name ; :c_mktsegment ?m . BIND(UCASE(?name) AS ?u) BIND(STRLEN(?m) AS ?len) BIND(STRAFTER(?name, "#") AS ?tail) FILTER(REGEX(?name, "1$") || CONTAINS(LCASE(?m), "auto")) }',
    {"c": "string", "u": "string", "len": "bigint", "tail": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c, upper(c_name) AS u, CAST(length(c_mktsegment) AS BIGINT) AS len, CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END AS tail FROM customer WHERE regexp_matches(c_name, '1$') OR contains(lower(c_mktsegment), 'auto')",
)
sparql(
    "sparql_values",
    ["orders"],
    'SELECT ?o ?s WHERE { VALUES (?s ?p) { ("F" "1-URGENT") ("O" UNDEF) } ?o :o_orderstatus ?s ; :o_orderpriority ?p }',
    {"o": "string", "s": "string"},
    "SELECT 'urn:order:' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'O'",
)
sparql(
    "sparql_subselect",
    ["orders", "customer"],
    "SELECT ?name ?n WHERE { { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :placedBy ?c } GROUP BY ?c } ?c :c_name ?name FILTER(?n >= 15) }",
    {"name": "string", "n": "bigint"},
    "SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey WHERE n >= 15",
)
sparql(
    "sparql_path_sequence",
    ["customer", "nation", "region"],
    "SELECT ?c ?r WHERE { ?c :nation/:region/:r_name ?r }",
    {"c": "string", "r": "string"},
    "SELECT 'urn:customer:' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
sparql(
    "sparql_path_plus",
    ["supplier", "nation"],
    "SELECT ?s ?where WHERE { ?s a :Supplier ; (:nation|:region)+ ?where }",
    {"s": "string", "where": "string"},
    "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS \"where\" FROM supplier UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
sparql(
    "sparql_path_inverse_negated",
    ["nation", "region"],
    "SELECT ?r ?n WHERE { ?r a :Region ; ^:region ?n . ?n !(a|:region) ?name }",
    {"r": "string", "n": "string"},
    "SELECT 'urn:region:' || n_regionkey AS r, 'urn:nation:' || n_nationkey AS n FROM nation",
)
sparql(
    "sparql_not_in",
    ["events"],
    'SELECT ?t (COUNT(*) AS ?n) WHERE { ?e :event_type ?t FILTER(?t NOT IN ("click", "view")) } GROUP BY ?t',
    {"t": "string", "n": "bigint"},
    "SELECT event_type AS t, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type",
)
sparql(
    "sparql_keyword_search",
    ["documents", "labels"],
    'SELECT ?d ?lang WHERE { ?d :text ?t OPTIONAL { ?d :lang ?lang } FILTER(CONTAINS(LCASE(?t), "license") || CONTAINS(LCASE(COALESCE(?lang, "")), "fr")) }',
    {"d": "string", "lang": "string"},
    "SELECT 'urn:doc:' || doc_id AS d, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(coalesce(lang, '')), 'fr')",
)
sparql(
    "sparql_offset_slice",
    ["nation"],
    "SELECT ?name WHERE { ?n :n_name ?name } ORDER BY DESC(?name) OFFSET 5 LIMIT 7",
    {"name": "string"},
    "SELECT n_name AS name FROM nation ORDER BY n_name DESC LIMIT 7 OFFSET 5",
)
sparql(
    "sparql_count_graph",
    ["orders", "customer"],
    "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?p) AS ?predicates) WHERE { ?s ?p ?o }",
    {"n": "bigint", "predicates": "bigint"},
    "SELECT (SELECT 6 * count(*) FROM orders) + (SELECT 5 * count(*) FROM customer) AS n, CAST(10 AS BIGINT) AS predicates",
)


# --- operators beyond SPARQL text

from pyspark.sql import functions as F  # noqa: E402

from quadloom.functions import terms as T  # noqa: E402
from quadloom.operators import app, extract, rdfs, schema, shacl  # noqa: E402
from quadloom.operators.store import QuadStore, diff  # noqa: E402
from quadloom.plans.fixpoint import closure  # noqa: E402
from quadloom.sources.mapping import quad, records, uri  # noqa: E402

VOCABULARY = f"""
@prefix : <{BASE}> . @prefix rdfs: <{T.RDFS}> .
:nation rdfs:subPropertyOf :locatedIn . :region rdfs:subPropertyOf :locatedIn . :locatedIn rdfs:subPropertyOf :relatedTo .
:placedBy rdfs:domain :Order ; rdfs:range :Customer .
:Customer rdfs:subClassOf :Party . :Supplier rdfs:subClassOf :Party . :Party rdfs:subClassOf :Thing .
"""


def _vocabulary(spark: SparkSession) -> DataFrame:
    from quadloom.sources import turtle

    return turtle.quads(spark, VOCABULARY, "")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RDFS_SQL = f"""
WITH loc AS (SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation)
SELECT s, '{BASE}locatedIn' AS p, o FROM loc UNION ALL SELECT s, '{BASE}relatedTo', o FROM loc
UNION ALL SELECT 'urn:customer:' || c_custkey, '{T.RDF}type', '{BASE}' || k FROM customer, (VALUES ('Party'), ('Thing')) v(k)
UNION ALL SELECT '{BASE}' || a, '{T.RDFS}subClassOf', '{BASE}Thing' FROM (VALUES ('Customer'), ('Supplier')) v(a)
UNION ALL SELECT '{BASE}' || a, '{T.RDFS}subPropertyOf', '{BASE}relatedTo' FROM (VALUES ('nation'), ('region')) v(a)
"""


@register("rdfs_infer", _RDFS_SQL)
def rdfs_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = shop(spark, sf_dir, ["customer", "nation"]).unionByName(_vocabulary(spark))
    return rdfs.infer(data).select("s", "p", "o")


@register("rdfs_domain_range", f"SELECT DISTINCT 'urn:customer:' || o_custkey AS s, '{BASE}Customer' AS o, 'rdfs3' AS rule FROM orders UNION ALL SELECT DISTINCT 'urn:customer:' || o_custkey, '{BASE}' || k, 'rdfs9' FROM orders, (VALUES ('Party'), ('Thing')) v(k)")
def rdfs_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders alone say that their customers are customers, parties and things."""
    data = shop(spark, sf_dir, ["orders"]).unionByName(_vocabulary(spark))
    return rdfs.infer(data).filter(F.col("p") == T.RDF + "type").select("s", "o", "rule")


@register("closure_cycle", "SELECT 'urn:nation:' || a.n_nationkey AS s, 'urn:nation:' || b.n_nationkey AS o FROM nation a, nation b")
def closure_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a ring: everything reaches everything."""
    nations = _table(spark, sf_dir, "nation")
    return closure(nations.select(uri("nation", F.col("n_nationkey")).alias("s"), uri("nation", (F.col("n_nationkey") + 1) % 25).alias("o")))


@register("closure_chain", "WITH c AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT a.o_orderkey AS s, b.o_orderkey AS o FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.n > b.n")
def closure_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order follows up the previous one of its customer; chains of all earlier orders."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s"), F.lag("o_orderkey").over(w).alias("o")).filter("o is not null")
    return closure(edges)


@register("graph_diff", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'unchanged' ELSE 'x' END AS k FROM orders) CROSS JOIN (VALUES ('added'), ('removed'), ('unchanged')) v(side) WHERE (k = 'unchanged' AND side = 'unchanged') OR (k = 'x' AND side IN ('added', 'removed')) GROUP BY side")
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states now and after all that aren't F have become X."""
    orders = _table(spark, sf_dir, "orders")
    state = lambda df: df.select(*quad("", uri("order", F.col("o_orderkey")), BASE + "o_orderstatus", T.LITERAL, F.col("o_orderstatus"), T.XSD_STRING))
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "F").otherwise("X"))
    return diff(state(orders), state(changed)).groupBy("side").agg(F.count("*").alias("n"))


@register("shacl_labels", "SELECT 'urn:doc:' || doc_id AS focus_node, 'MinCountConstraintComponent' AS component FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'urn:doc:' || doc_id, 'MinInclusiveConstraintComponent' FROM labels WHERE quality < 1")
def shacl_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = f"""@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . @prefix xsd: <{T.XSD}> .
    :DocShape a sh:NodeShape ; sh:targetClass :Doc ; sh:property [ sh:path :quality ; sh:minCount 1 ; sh:datatype xsd:integer ; sh:minInclusive 1 ] ."""
    return shacl.validate(shop(spark, sf_dir, ["documents", "labels"]), shapes).select("focus_node", "component")


@register("shacl_balances", "SELECT 'urn:customer:' || c_custkey AS focus_node, 'below zero' AS message FROM customer WHERE c_acctbal < 0")
def shacl_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = f"""@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> .
    :S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ; sh:maxCount 1 ; sh:message "below zero" ] ; sh:property [ sh:path :nation ; sh:nodeKind sh:IRI ; sh:minCount 1 ] ."""
    return shacl.validate(shop(spark, sf_dir, ["customer"]), shapes).select("focus_node", "message")


@register("schema_histogram", f"SELECT '{BASE}' || c AS class, '{BASE}' || p AS predicate, n FROM (SELECT 'Part' AS c, p, count(*) AS n FROM part, (VALUES ('p_name'), ('p_brand'), ('p_size'), ('p_retailprice'), ('p_type')) v(p) GROUP BY p)")
def schema_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schema.predicate_histogram(shop(spark, sf_dir, ["part"]), BASE + "Part").filter(F.col("predicate") != T.RDF + "type")
    return rows.select(F.lit(BASE + "Part").alias("class"), "predicate", "n")


@register("schema_classes", f"SELECT '{BASE}Customer' AS class, count(*) AS n FROM customer UNION ALL SELECT '{BASE}Nation', count(*) FROM nation UNION ALL SELECT '{BASE}Event', count(*) FROM events")
def schema_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.class_histogram(shop(spark, sf_dir, ["customer", "nation", "events"]))


@register("update_delete_insert", "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def update_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, shop(spark, sf_dir, ["orders"]).filter(F.col("p") == BASE + "o_orderstatus"), prefixes=PREFIXES)
    store.update('DELETE { ?o :o_orderstatus "O" } INSERT { ?o :o_orderstatus "open" } WHERE { ?o :o_orderstatus "O" }')
    return to_native(store.query("SELECT ?status (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?status } GROUP BY ?status"), {"status": "string", "n": "bigint"})


@register("construct_located", f"SELECT DISTINCT 'urn:nation:' || c_nationkey AS s, '{BASE}hasSegment' AS p, c_mktsegment AS o FROM customer")
def construct_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_query("CONSTRUCT { ?n :hasSegment ?m } WHERE { ?c :nation ?n ; :c_mktsegment ?m }", PREFIXES)
    return Compiler(shop(spark, sf_dir, ["customer"])).construct(q).select("s", "p", "o")


@register("describe_nation", "SELECT s, o FROM (SELECT 'urn:nation:' || n_nationkey AS s, n_name AS o FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation) WHERE s = 'urn:nation:7'")
def describe_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_query("DESCRIBE <urn:nation:7>", PREFIXES)
    return Compiler(shop(spark, sf_dir, ["nation"])).describe(q).filter(F.col("p") != T.RDF + "type").select("s", "o")


@register("named_graph_sizes", "SELECT 'urn:g:customer' AS graph, 5 * count(*) AS n FROM customer UNION ALL SELECT 'urn:g:nation', 3 * count(*) FROM nation")
def named_graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = shop(spark, sf_dir, ["customer"], "urn:g:customer").unionByName(shop(spark, sf_dir, ["nation"], "urn:g:nation"))
    return to_native(Compiler(data).select(parse_query("SELECT ?graph (COUNT(*) AS ?n) WHERE { GRAPH ?graph { ?s ?p ?o } } GROUP BY ?graph")), {"graph": "string", "n": "bigint"})


@register("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(_table(spark, sf_dir, "pages"))


@register("day_records", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS VARCHAR) || ' commits' AS title, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1")
def day_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").select(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")).alias("value"))
    return extract.commit_days(lines).select("day", "title", F.size("messages").alias("n"))


@register("record_quads", f"SELECT 'urn:doc:' || doc_id AS s, '{BASE}lang' AS p, lang AS o FROM documents UNION ALL SELECT 'urn:doc:' || doc_id, '{T.RDF}type', '{BASE}Text' FROM documents")
def record_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(uri("doc", F.col("doc_id")).alias("s"), "lang")
    return records(docs, "s", "Text", "", {"lang": ("lang", T.XSD_STRING)}).select("s", "p", "o")


@register("impact_severity", "SELECT 'urn:region:' || r_regionkey AS node, count(n_nationkey) AS dependents, CASE WHEN count(n_nationkey) = 0 THEN 'low' WHEN count(n_nationkey) <= 3 THEN 'medium' ELSE 'high' END AS impact FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey UNION ALL SELECT 'urn:nation:' || n_nationkey, 0, 'low' FROM nation")
def impact_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").select(uri("nation", F.col("n_nationkey")).alias("s"), uri("region", F.col("n_regionkey")).alias("o"))
    return app.dependents_with_severity(nations)


@register("ntriples_lines", f"SELECT '<urn:nation:' || n_nationkey || '> <{BASE}n_name> \"' || n_name || '\" .' AS line FROM nation")
def ntriples_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources import turtle

    return turtle.lines(shop(spark, sf_dir, ["nation"]).filter(F.col("p") == BASE + "n_name")).withColumnRenamed("value", "line")

from quadloom.plans import registry_ops, registry_scan, registry_sparql, registry_tables  # noqa: E402, F401
