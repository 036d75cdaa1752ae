"""Named queries of the store, inference, validation, schema, extraction and application operators, each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators import app, extract, rdfs, scan, schema, shacl
from quadloom.operators.store import QuadStore, diff, results_json, slug
from quadloom.plans.compiler import to_native
from quadloom.plans.fixpoint import checkpointed
from quadloom.plans.registry import PREFIXES, VOCABULARY, _table, _vocabulary, register
from quadloom.sources import turtle
from quadloom.sources.mapping import BASE, quad, shop, uri

G, H = "urn:g:one", "urn:g:two"
X = T.XSD


def _names(spark: SparkSession, sf_dir: str, g: str = G) -> DataFrame:
    """Names of the nations."""
    return shop(spark, sf_dir, ["nation"], g).filter(F.col("p") == BASE + "n_name")


def _store(spark: SparkSession, sf_dir: str, *graphs: str) -> QuadStore:
    store = QuadStore(spark, prefixes=dict(PREFIXES))
    for g in graphs or (G,):
        store.insert(_names(spark, sf_dir, g))
    return store


def _spo(store: QuadStore) -> DataFrame:
    return store.quads.select("g", "s", "o")


def _folder(spark: SparkSession) -> str:
    checkpointed(spark.range(1))  # sets the folder that executors share
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


_N = "SELECT '{g}' AS g, 'urn:nation:' || n_nationkey AS s, n_name AS o FROM nation"
_ONE, _TWO = _N.format(g=G), _N.format(g=H)


@register("store_insert_data", f"{_ONE} UNION ALL SELECT '{G}', 'urn:nation:99', 'NEW' UNION ALL SELECT '', 'urn:x', 'plain'")
def store_insert_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.update(f'INSERT DATA {{ GRAPH <{G}> {{ <urn:nation:99> :n_name "NEW" , "NEW" }} }} ; INSERT DATA {{ <urn:x> :n_name "plain" }} ; INSERT DATA {{ <urn:x> :n_name "plain" }}')
    return _spo(store)


@register("store_delete_data", f"{_ONE} WHERE n_nationkey <> 3")
def store_delete_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 3").first().n_name
    store.update(f'DELETE DATA {{ GRAPH <{G}> {{ <urn:nation:3> :n_name {json.dumps(name)} . <urn:nation:4> :n_name "other" }} }}')
    return _spo(store)


@register("store_delete_where", f"{_ONE} WHERE n_name NOT LIKE 'A%'")
def store_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete(G, where='FILTER(STRSTARTS(?o, "A"))')
    return _spo(store)


@register("store_delete_where_pattern", f"{_ONE}")
def store_delete_where_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, G, H)
    store.update(f"DELETE WHERE {{ GRAPH <{H}> {{ ?s :n_name ?o }} }}")
    return _spo(store)


@register("store_delete_subject", f"{_ONE} WHERE n_nationkey NOT IN (1, 2) UNION ALL {_TWO}")
def store_delete_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All about two subjects, as a union of patterns; the other graph keeps its own."""
    store = _store(spark, sf_dir, G, H)
    store.update(f"WITH <{G}> DELETE {{ ?s ?p ?o }} WHERE {{ {{ ?s ?p ?o FILTER(?s = <urn:nation:1>) }} UNION {{ ?s ?p ?o FILTER(?s = <urn:nation:2>) }} }}")
    return _spo(store)


@register("store_delete_predicate", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation")
def store_delete_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate goes and classes go; the links stay."""
    store = QuadStore(spark, shop(spark, sf_dir, ["nation"], G), prefixes=dict(PREFIXES))
    store.update(f"DELETE {{ GRAPH <{G}> {{ ?s ?p ?o }} }} WHERE {{ GRAPH <{G}> {{ ?s ?p ?o FILTER(?p IN (:n_name, <{T.RDF}type>)) }} }}")
    return store.quads.select("s", "o")


@register("store_using", f"{_TWO} WHERE n_nationkey < 5 UNION ALL {_ONE}")
def store_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USING NAMED only names what GRAPH may reach; the default graph is empty then."""
    store = _store(spark, sf_dir)
    store.update(f"INSERT {{ GRAPH <{H}> {{ ?s ?p ?o }} }} USING NAMED <{G}> WHERE {{ GRAPH ?g {{ ?s ?p ?o }} FILTER(?s IN (<urn:nation:0>, <urn:nation:1>, <urn:nation:2>, <urn:nation:3>, <urn:nation:4>)) }} ; INSERT {{ GRAPH <{H}> {{ ?s ?p ?o }} }} USING NAMED <{G}> WHERE {{ ?s ?p ?o }}")
    return _spo(store)


@register("store_transfer", f"{_ONE} UNION ALL SELECT 'urn:g:moved', 'urn:nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'urn:g:sum', 'urn:nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'urn:g:sum', 'urn:a', 'b'")
def store_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.update(f'INSERT DATA {{ GRAPH <urn:g:sum> {{ <urn:a> :n_name "b" }} GRAPH <urn:g:old> {{ <urn:c> :n_name "d" }} }}')
    store.update(f"COPY <{G}> TO <urn:g:old> ; ADD <{G}> TO <urn:g:sum> ; MOVE <urn:g:old> TO <urn:g:moved>")
    return _spo(store)


@register("store_drop_clear", f"{_TWO}")
def store_drop_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, G, H, "urn:g:three")
    store.update(f'INSERT DATA {{ <urn:x> :n_name "plain" }} ; DROP GRAPH <{G}> ; CLEAR GRAPH <urn:g:three> ; DROP SILENT GRAPH <urn:g:none> ; CLEAR DEFAULT ; CREATE SILENT GRAPH <{H}> ; CREATE GRAPH <urn:g:new>')
    return _spo(store)


@register("store_replace", f"SELECT 'urn:a' AS s, 'b' AS o UNION ALL SELECT 'urn:nation:' || n_nationkey, n_name FROM nation")
def store_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph is replaced; its version before, and the other graph, are kept."""
    store = _store(spark, sf_dir, G)
    store.history = _folder(spark)
    store.replace_graph(G, '<urn:a> <urn:p> "b" .')
    (kept,) = store.snapshots(store.history, G)
    return store.graph(G).select("s", "o").unionAll(spark.read.parquet(kept["path"]).select("s", "o"))


@register("store_snapshots", f"SELECT 'restored' AS what, 'urn:nation:' || n_nationkey AS s FROM nation UNION ALL SELECT 'pre-rollback', 'urn:b' UNION ALL SELECT 'regular', CAST(k AS VARCHAR) FROM (VALUES (2)) v(k)")
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, root = _store(spark, sf_dir), _folder(spark)
    stamp = store.snapshot(root, G, keep=2)
    for name in ("urn:a", "urn:b"):
        store.replace_graph(G, f'<{name}> <urn:p> "x" .')
        if name == "urn:a":
            store.snapshot(root, G, keep=2)
    store.restore(root, G, stamp)
    found = store.snapshots(root, G)
    before = next(r for r in found if r["isPreRollback"])
    regular = spark.createDataFrame([("regular", str(sum(not r["isPreRollback"] for r in found)))], "what string, s string")
    return store.graph(G).select(F.lit("restored").alias("what"), "s").unionAll(spark.read.parquet(before["path"]).select(F.lit("pre-rollback"), "s")).unionAll(regular)


@register("store_catalog", f"SELECT * FROM (SELECT 'names' AS name, 'http://e.org/names' AS graph, count(*) AS triples FROM nation UNION ALL SELECT 'empty', 'http://e.org/empty', NULL UNION ALL SELECT '?', '{G}', count(*) FROM nation)")
def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered graphs and those in the store: either may lack the other."""
    store = QuadStore(spark, prefixes=dict(PREFIXES))
    for name in ("names", "empty", "gone"):
        store.graph_create(name, "http://e.org/")
    store.insert(_names(spark, sf_dir, store.graph_iri("names")).unionByName(_names(spark, sf_dir, G)))
    store.graph_drop("gone", confirm=True)
    return store.graph_list()


@register("store_status", f"SELECT '{G}' AS graph, count(*) AS asserted, count(*) AS inferred, 2 * count(*) AS total FROM nation")
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.insert(store.quads.withColumn("p", F.lit("urn:derived")).withColumn("inferred", F.lit(True)))
    store.insert(store.quads.filter("not inferred").withColumn("inferred", F.lit(True)))  # asserted ones stay asserted
    return schema.status(store.quads)


@register("store_assert_inferred", "SELECT inferred, count(*) AS n FROM (SELECT n_nationkey >= 10 AS inferred FROM nation) GROUP BY inferred")
def store_assert_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was inferred and is asserted later counts as asserted."""
    store = QuadStore(spark, _names(spark, sf_dir).withColumn("inferred", F.lit(True)))
    store.insert(_names(spark, sf_dir).filter(F.regexp_extract("s", r"(\d+)$", 1).cast("int") < 10))
    return store.quads.groupBy("inferred").agg(F.count("*").alias("n"))


@register("store_save", f"{_ONE} UNION ALL {_TWO}")
def store_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _store(spark, sf_dir, G, H).save(path)
    return spark.read.parquet(path).select("g", "s", "o")


@register("store_export_import", f"SELECT '{H}' AS g, 'urn:doc:' || doc_id AS s, '{BASE}' || p AS p, o FROM (SELECT doc_id, 'lang' AS p, lang AS o FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents) WHERE o IS NOT NULL")
def store_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts written as N-Triples and read again: escapes and all."""
    rows = shop(spark, sf_dir, ["documents"], G).filter(F.col("p").isin(*[BASE + x for x in ("lang", "source", "text")]))
    store, path = QuadStore(spark, rows), _folder(spark)
    store.export_to(G, path)
    lines = spark.read.text(path, wholetext=False, lineSep="\n")
    return turtle.read_lines(lines, H).select("g", "s", "p", "o")


@register("turtle_round_trip", f"SELECT '{G}' AS g, 'urn:region:' || r_regionkey AS s, '{BASE}' || p AS p, o FROM (SELECT r_regionkey, 'r_name' AS p, r_name AS o FROM region) UNION ALL SELECT '{G}', 'urn:region:' || r_regionkey, '{T.RDF}type', '{BASE}Region' FROM region")
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, shop(spark, sf_dir, ["region"], H))
    store.insert_turtle(store.export(H), G)
    store.insert_turtle(store.export(H), G)
    return store.graph(G).select("g", "s", "p", "o")


@register("graph_diff_rows", f"SELECT 'urn:order:' || o_orderkey AS s, o, side FROM (SELECT o_orderkey, o_orderstatus AS o, CASE WHEN o_orderstatus = 'F' THEN 'unchanged' ELSE 'removed' END AS side FROM orders UNION ALL SELECT o_orderkey, 'X', 'added' FROM orders WHERE o_orderstatus <> 'F')")
def graph_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triple with its side; triples that stand twice count once."""
    orders = _table(spark, sf_dir, "orders")
    state = lambda df: df.select(*quad("", uri("order", F.col("o_orderkey")), BASE + "o_orderstatus", T.LITERAL, F.col("o_orderstatus"), T.XSD_STRING))
    changed = state(orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "F").otherwise("X")))
    return diff(state(orders), changed.unionAll(changed)).select("s", "o", "side")


@register("graph_diff_truncated", "SELECT CAST(2 AS BIGINT) AS listed, count(*) FILTER (n_nationkey > 20) AS added, count(*) FILTER (n_nationkey < 20) AS removed, CAST(1 AS BIGINT) AS unchanged, true AS truncated FROM nation")
def graph_diff_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are cut, counts are not."""
    store = QuadStore(spark)
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("int")
    store.insert(_names(spark, sf_dir).filter(number <= 20))
    text = "\n".join(r.value for r in turtle.lines(_names(spark, sf_dir).filter(number >= 20)).collect())
    d = store.diff(G, text, limit=2)
    assert len(d["added"]) == len(d["removed"]) == 2
    return spark.createDataFrame([(2, d["addedCount"], d["removedCount"], d["unchanged"], d["truncated"])], "listed bigint, added bigint, removed bigint, unchanged bigint, truncated boolean")


@register("results_as_json", "SELECT n_name AS name, CASE WHEN n_nationkey < 5 THEN 'urn:nation:' || n_nationkey END AS n FROM nation")
def results_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir).query('SELECT ?name ?n { ?x :n_name ?name OPTIONAL { ?x :n_name ?name BIND(?x AS ?n) FILTER(STRLEN(STR(?n)) = 12 && SUBSTR(STR(?n), 12) < "5") } }', G)
    rows = json.loads(results_json(found))["results"]["bindings"]
    return spark.createDataFrame([(r["name"]["value"], r.get("n", {}).get("value")) for r in rows], "name string, n string")


# --- inference


@register("rdfs_domain", f"SELECT 'urn:order:' || o_orderkey AS s, '{BASE}Order' AS o, 'rdfs2' AS rule FROM orders")
def rdfs_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a class get the one that what they are placed by says."""
    data = shop(spark, sf_dir, ["orders"]).filter(F.col("p") == BASE + "placedBy").unionByName(_vocabulary(spark))
    return rdfs.infer(data).filter(F.col("o") == BASE + "Order").select("s", "o", "rule")


@register("rdfs_materialized", "SELECT 'rdfs9' AS rule, 2 * (SELECT count(*) FROM customer) AS n, true AS flagged, true AS cleared UNION ALL SELECT 'rdfs7', 2 * (SELECT count(*) FROM customer), true, true UNION ALL SELECT 'rdfs11', 2, true, true UNION ALL SELECT 'rdfs5', 2, true, true")
def rdfs_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred once, however often it is asked for; counted by rule; gone when cleared, with asserted triples left."""
    asserted = shop(spark, sf_dir, ["customer"], G).unionByName(_vocabulary(spark).withColumn("g", F.lit(G)))
    store = QuadStore(spark, checkpointed(asserted))
    first, counts = rdfs.materialize(store, G), rdfs.materialize(store, G)
    flagged = store.graph(G).filter("inferred").count() == counts["inferredCount"] == first["inferredCount"]
    before = counts["assertedCount"]
    rdfs.clear(store, G)
    cleared = store.count(G) == before and store.graph(G).filter("inferred").isEmpty()
    return spark.createDataFrame([(r, n, flagged, cleared) for r, n in counts["rules"].items()], "rule string, n bigint, flagged boolean, cleared boolean")


@register("rdfs_fixpoint", f"SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_acctbal < 0")
def rdfs_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class that follows from a property that follows from another: two rounds."""
    text = f"@prefix rdfs: <{T.RDFS}> . @prefix : <{BASE}> . :owes rdfs:subPropertyOf :hasDebt . :hasDebt rdfs:domain :Debtor ."
    owes = _table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(*quad("", uri("customer", F.col("c_custkey")), BASE + "owes", T.LITERAL, F.col("c_acctbal").cast("string"), T.XSD_DOUBLE))
    return rdfs.infer(owes.unionByName(turtle.quads(spark, text, "")), "fixpoint").filter(F.col("o") == BASE + "Debtor").select("s")


@register("closure_rounds", "WITH RECURSIVE c(s, o) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 1 UNION SELECT c.s, c.o // 2 FROM c WHERE c.o > 1) SELECT s, o FROM c")
def closure_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of all customers: too many edges for one list."""
    from quadloom.plans.fixpoint import closure

    key = F.col("c_custkey")
    return closure(_table(spark, sf_dir, "customer").filter(key > 1).select(key.alias("s"), F.floor(key / 2).alias("o")))


# --- shapes


def _violations(spark: SparkSession, data: DataFrame, constraints: str, target: str = "sh:targetClass :Customer") -> DataFrame:
    shapes = f"@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . @prefix xsd: <{X}> . :S a sh:NodeShape ; {target} ; {constraints} ."
    return shacl.validate(data, shapes).select("focus_node", F.regexp_replace("component", "ConstraintComponent$", "").alias("component"))


_C = "SELECT 'urn:customer:' || c_custkey AS focus_node, '{}' AS component FROM customer WHERE {}"


@register("shacl_values", " UNION ALL ".join([_C.format("MinExclusive", "c_acctbal <= 0"), _C.format("MaxExclusive", "c_acctbal >= 9000"), _C.format("MaxInclusive", "c_acctbal > 9500"), _C.format("MinLength", "length(c_mktsegment) < 9"), _C.format("MaxLength", "length(c_mktsegment) > 9"), _C.format("Pattern", "NOT starts_with(c_mktsegment, 'B')"), _C.format("In", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), _C.format("HasValue", "c_mktsegment <> 'BUILDING'"), _C.format("NodeKind", "true"), _C.format("Datatype", "true")]))
def shacl_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(
        spark,
        shop(spark, sf_dir, ["customer"]),
        'sh:property [ sh:path :c_acctbal ; sh:minExclusive 0 ; sh:maxExclusive 9000 ; sh:maxInclusive 9500 ; sh:datatype xsd:integer ] ; sh:property [ sh:path :c_mktsegment ; sh:minLength 9 ; sh:maxLength 9 ; sh:pattern "^b" ; sh:flags "i" ; sh:in ( "BUILDING" "MACHINERY" ) ; sh:hasValue "BUILDING" ; sh:nodeKind sh:IRI ]',
    )


@register("shacl_logic", " UNION ALL ".join([_C.format("Not", "c_acctbal < 0"), _C.format("Or", "c_acctbal < 9000 AND c_mktsegment <> 'BUILDING'"), _C.format("And", "c_acctbal < 5000 OR c_mktsegment <> 'BUILDING'"), _C.format("Xone", "(c_acctbal >= 5000) = (c_mktsegment = 'BUILDING')")]))
def shacl_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    negative, rich, richest, building = "[ sh:property [ sh:path :c_acctbal ; sh:maxExclusive 0 ] ]", "[ sh:property [ sh:path :c_acctbal ; sh:minInclusive 5000 ] ]", "[ sh:property [ sh:path :c_acctbal ; sh:minInclusive 9000 ] ]", '[ sh:property [ sh:path :c_mktsegment ; sh:in ( "BUILDING" ) ] ]'
    return _violations(spark, shop(spark, sf_dir, ["customer"]), f"sh:not {negative} ; sh:or ( {richest} {building} ) ; sh:and ( {rich} {building} ) ; sh:xone ( {rich} {building} )")


@register("shacl_pairs", "SELECT 'urn:part:' || p_partkey AS focus_node, 'LessThan' AS component FROM part WHERE p_size >= p_retailprice UNION ALL SELECT 'urn:part:' || p_partkey, 'Disjoint' FROM part WHERE p_size = 7 UNION ALL SELECT 'urn:part:' || p_partkey, 'Equals' FROM part, (VALUES (1), (2)) v(k) WHERE p_size <> 7 UNION ALL SELECT 'urn:part:' || p_partkey, 'Closed' FROM part")
def shacl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = _table(spark, sf_dir, "part").select(*quad("", uri("part", F.col("p_partkey")), BASE + "seven", T.LITERAL, F.lit("7"), T.XSD_INTEGER))
    data = shop(spark, sf_dir, ["part"]).filter(~F.col("o").startswith(BASE + "PartType/"))
    ignored = f"sh:closed true ; sh:ignoredProperties ( <{T.RDF}type> :p_name :p_brand :p_retailprice :p_type )"
    return _violations(spark, data.unionByName(seven), f"{ignored} ; sh:property [ sh:path :p_size ; sh:lessThan :p_retailprice ; sh:disjoint :seven ; sh:equals :seven ]", "sh:targetClass :Part")


@register("shacl_classes", "SELECT 'urn:nation:' || n_nationkey AS focus_node, 'Class' AS component FROM nation WHERE n_regionkey > 2 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'Node' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(r_name) > 4 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'QualifiedMinCount' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(r_name) > 4")
def shacl_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of a class below the one that is asked for count as its own, as targets and as values."""
    text = f"@prefix rdfs: <{T.RDFS}> . @prefix : <{BASE}> . :Region rdfs:subClassOf :Area . :Area rdfs:subClassOf :Place . :Nation rdfs:subClassOf :State ."
    data = shop(spark, sf_dir, ["nation", "region"]).filter(~((F.col("p") == T.RDF + "type") & F.col("s").isin("urn:region:3", "urn:region:4"))).unionByName(turtle.quads(spark, text, ""))
    short = "[ sh:property [ sh:path :r_name ; sh:maxLength 4 ] ]"
    return _violations(spark, data, f"sh:property [ sh:path :region ; sh:class :Place ; sh:node {short} ; sh:qualifiedValueShape {short} ; sh:qualifiedMinCount 1 ]", "sh:targetClass :State")


@register("shacl_targets", "SELECT 'urn:region:1' AS focus_node, 'MaxLength' AS component FROM region WHERE r_regionkey = 1 AND length(r_name) > 4 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'MaxLength' FROM nation WHERE length(n_name) > 4")
def shacl_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by node and by predicate; severity and message of the shape."""
    data = shop(spark, sf_dir, ["nation", "region"])
    shapes = f'@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . :A sh:targetNode <urn:region:1> ; sh:property [ sh:path :r_name ; sh:maxLength 4 ; sh:severity sh:Warning ] . :B sh:targetSubjectsOf :n_name ; sh:property [ sh:path :n_name ; sh:maxLength 4 ; sh:message "long" ] .'
    found = shacl.validate(data, shapes).filter("severity = 'Warning' and focus_node like 'urn:region%' or message = 'long' and severity = 'Violation'")
    return found.select("focus_node", F.regexp_replace("component", "ConstraintComponent$", "").alias("component"))


# --- schema


@register("schema_overview", f"SELECT 'class' AS what, '{BASE}' || k AS name FROM (VALUES ('Nation'), ('Region')) v(k) UNION ALL SELECT 'predicate', '{BASE}' || k FROM (VALUES ('n_name'), ('region'), ('r_name')) v(k) UNION ALL SELECT 'predicate', '{T.RDF}type' UNION ALL SELECT 'triples', CAST((SELECT 3 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region) AS VARCHAR)")
def schema_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = schema.overview(shop(spark, sf_dir, ["nation", "region"]))
    return spark.createDataFrame([("class", c) for c in seen["classes"]] + [("predicate", p) for p in seen["predicates"]] + [("triples", str(seen["tripleCount"]))], "what string, name string")


@register("schema_class_details", f"SELECT '{BASE}' || p AS predicate, count(*) AS n, CAST(5 AS BIGINT) AS samples FROM nation, (VALUES ('n_name'), ('region')) v(p) GROUP BY p UNION ALL SELECT '{T.RDF}type', count(*), 5 FROM nation")
def schema_class_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = schema.class_details(shop(spark, sf_dir, ["nation", "region"]), BASE + "Nation")
    return spark.createDataFrame([(p, n, len(d["sampleTriples"])) for p, n in d["predicates"]], "predicate string, n bigint, samples bigint")


@register("schema_graph_data", "SELECT 'node' AS what, 'urn:nation:' || n_nationkey AS id, 'Instance' AS kind FROM nation UNION ALL SELECT 'node', 'urn:region:' || n_regionkey, 'Instance' FROM nation GROUP BY n_regionkey UNION ALL SELECT 'node', 'urn:nation:' || n_nationkey || '|" + BASE + "n_name|' || n_name, 'Literal' FROM nation UNION ALL SELECT 'edge', 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation UNION ALL SELECT 'edge', 'urn:nation:' || n_nationkey, 'urn:nation:' || n_nationkey || '|" + BASE + "n_name|' || n_name FROM nation")
def schema_graph_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = schema.graph_data(shop(spark, sf_dir, ["nation"]))
    return nodes.select(F.lit("node").alias("what"), "id", "kind").unionAll(edges.select(F.lit("edge"), "source", "target"))


@register("schema_visible", "SELECT 'urn:nation:' || n_nationkey AS source, 'urn:region:1' AS target FROM nation WHERE n_regionkey = 1")
def schema_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = schema.graph_data(shop(spark, sf_dir, ["nation", "region"]))
    return schema.visible(nodes, edges, kinds=["Instance"], focus="urn:region:1")[1].select("source", "target")


@register("schema_search", "SELECT 'urn:nation:' || n_nationkey AS id FROM nation WHERE n_nationkey >= 10 AND n_nationkey < 20")
def schema_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = schema.graph_data(shop(spark, sf_dir, ["nation"]).filter(F.col("p") == T.RDF + "type"))
    assert schema.search_nodes(nodes, "x").isEmpty()
    return schema.search_nodes(nodes, "NATION:1").filter("id <> 'urn:nation:1'").select("id")


@register("schema_neighbourhood", "SELECT 'urn:nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:region:2' UNION ALL SELECT '" + BASE + "Region'")
def schema_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.neighbourhood(shop(spark, sf_dir, ["nation", "region"]), "urn:region:2")


# --- code bases


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each customer: imports its nation's module, a package, and one that isn't there."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("import {a} from '../n"), nation, F.lit("';\nimport x from '@scope/p"), nation, F.lit("/deep';\nexport * from './none';\nconst y = require('lib"), nation, F.lit("/sub')\n"))
    customers = _table(spark, sf_dir, "customer").select(F.concat(F.lit("src/c/c"), key, F.lit(".ts")).alias("path"), text.alias("text"))
    n = F.col("n_nationkey")
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("src/n"), n.cast("string"), F.when(n % 2 == 0, ".ts").otherwise("/index.js")).alias("path"), F.lit("import './nowhere'").alias("text"))
    return customers.unionAll(nations)


_MODULE = "CASE WHEN c_nationkey % 2 = 0 THEN 'src/n' || c_nationkey ELSE 'src/n' || c_nationkey || '/index' END"


@register("scan_local_imports", f"SELECT 'src/c/c' || c_custkey AS source, {_MODULE} AS target FROM customer")
def scan_local_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.local_imports(_files(spark, sf_dir))


@register("scan_external_imports", "SELECT DISTINCT k || c_nationkey AS package FROM customer, (VALUES ('@scope/p'), ('lib')) v(k)")
def scan_external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.external_imports(_files(spark, sf_dir))


@register("scan_tree", "SELECT 'src' AS path, 'src' AS name, 1 AS depth, 'directory' AS kind UNION ALL SELECT 'src/c', 'c', 2, 'directory' UNION ALL SELECT 'src/c/c' || c_custkey || '.ts', 'c' || c_custkey || '.ts', 3, 'file' FROM customer UNION ALL SELECT 'src/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '' END, 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '' END, 2, CASE WHEN n_nationkey % 2 = 0 THEN 'file' ELSE 'directory' END FROM nation UNION ALL SELECT 'src/n' || n_nationkey || '/index.js', 'index.js', 3, 'file' FROM nation WHERE n_nationkey % 2 = 1")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = spark.createDataFrame([("src/c/deep/er/x.ts", "")], "path string, text string")
    return scan.tree(_files(spark, sf_dir).unionAll(deep)).filter("path not like 'src/c/deep%'")


@register("scan_truncated", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '... (truncated)' ELSE text END AS text FROM documents")
def scan_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", scan.truncated(F.col("text"), 3).alias("text"))


@register("scan_python_symbols", "SELECT 'n' || n_nationkey || '.py' AS path, kind, replace(name, '#', CAST(n_nationkey AS VARCHAR)) AS name FROM nation, (VALUES ('Class', 'N#'), ('Interface', 'P#'), ('Method', 'm#'), ('Function', 'f#')) v(kind, name)")
def scan_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.python_symbols(_python(spark, sf_dir)).select("path", "kind", "name")


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "class N#(Base):\n    def __init__(self): pass\n    def m#(self, a) -> int:\n        return f#(self.m#(a))\nclass P#(Protocol): pass\ndef f#(x):\n    print(x)\n"
    return _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.replace(F.lit(code), F.lit("#"), F.col("n_nationkey").cast("string")).alias("text"))


@register("scan_python_calls", "SELECT 'urn:call:N' || n_nationkey || '.m' || n_nationkey || '--' || callee AS s, replace(caller, '#', CAST(n_nationkey AS VARCHAR)) || ' -> ' || callee AS title FROM (SELECT n_nationkey, 'N#.m#' AS caller, replace(c, '#', CAST(n_nationkey AS VARCHAR)) AS callee FROM nation, (VALUES ('f#'), ('N#.m#')) v(c))")
def scan_python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = scan.call_quads(scan.python_calls(_python(spark, sf_dir)), G, BASE)
    return quads.filter(F.col("p") == BASE + "title").select("s", F.col("o").alias("title"))


@register("scan_declared_symbols", "SELECT 'f' || n_nationkey AS path, lang, kind, name || n_nationkey AS name FROM nation, (VALUES ('go', 'Class', 'S'), ('go', 'Interface', 'I'), ('go', 'Function', 'F'), ('go', 'Method', 'M'), ('rust', 'Class', 'S'), ('rust', 'Interface', 'T'), ('rust', 'Function', 'f'), ('java', 'Class', 'C'), ('java', 'Interface', 'I'), ('swift', 'Class', 'S'), ('swift', 'Interface', 'P'), ('swift', 'Function', 'f'), ('typescript', 'Class', 'C'), ('typescript', 'Interface', 'I'), ('typescript', 'Function', 'f')) v(lang, kind, name)")
def scan_declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = {
        "go": "type S# struct {\n}\ntype I# interface {\n}\nfunc F#(a int) {}\nfunc (s *S) M#() {}\n",
        "rust": "pub struct S# {}\npub(crate) trait T# {}\npub async fn f#() {}\n",
        "java": "public final class C# {}\ninterface I# {}\n",
        "swift": "public struct S# {}\nprotocol P# {}\nfunc f#() {}\n",
        "typescript": "export abstract class C# {}\nexport interface I# {}\nexport async function f#() {}\n",
    }
    out = None
    for language, text in code.items():
        n = F.col("n_nationkey").cast("string")
        files = _table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), n).alias("path"), F.replace(F.lit(text), F.lit("#"), n).alias("text"))
        part = extract.declared_symbols(files, language).select("path", F.lit(language).alias("lang"), "kind", "name")
        out = part if out is None else out.unionAll(part)
    return out


_SYM = "'urn:symbol:src%2Fn' || n_nationkey || '.ts/"


@register(
    "scan_symbol_triples",
    f"""SELECT s, '{BASE}' || p AS p, o FROM (
    SELECT {_SYM}class/C' AS s, 'title' AS p, 'C' AS o FROM nation UNION ALL SELECT {_SYM}class/C', 'definedIn', 'urn:module:src/n' || n_nationkey FROM nation
    UNION ALL SELECT {_SYM}class/C', 'extends', 'urn:symbol:src%2Fb.ts/class/Base' FROM nation UNION ALL SELECT {_SYM}class/C', 'implements', 'urn:symbol:src%2Fb.ts/interface/I' FROM nation
    UNION ALL SELECT {_SYM}class/C', 'hasMethod', {_SYM}method/C.m' FROM nation UNION ALL SELECT {_SYM}method/C.m', 'title', 'm' FROM nation UNION ALL SELECT {_SYM}method/C.m', 'definedIn', 'urn:module:src/n' || n_nationkey FROM nation
    UNION ALL SELECT {_SYM}method/C.m', 'returns', 'string' FROM nation UNION ALL SELECT {_SYM}method/C.m', 'paramType', x FROM nation, (VALUES ('a: int'), ('b: T')) v(x)
    UNION ALL SELECT {_SYM}interface/J', 'title', 'J' FROM nation UNION ALL SELECT {_SYM}interface/J', 'definedIn', 'urn:module:src/n' || n_nationkey FROM nation UNION ALL SELECT {_SYM}interface/J', 'extends', 'K' FROM nation
    UNION ALL SELECT {_SYM}function/f', 'title', 'f' FROM nation UNION ALL SELECT {_SYM}function/f', 'definedIn', 'urn:module:src/n' || n_nationkey FROM nation)""",
)
def scan_symbol_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(
        [("Class", "C", None, ["src/b.ts/class/Base"], ["src/b.ts/interface/I"], [], None), ("Method", "m", "C", [], [], ["a: int", "b: T"], "string"), ("Interface", "J", None, ["K"], [], [], None), ("Function", "f", None, [], [], ["z: Z"], "void")],
        "kind string, name string, parent string, bases array<string>, implements array<string>, parameters array<string>, returns string",
    )
    files = _table(spark, sf_dir, "nation").select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"))
    quads = scan.symbol_quads(files.crossJoin(F.broadcast(kinds)), G, BASE)  # four rows of kinds
    return quads.filter(F.col("p") != T.RDF + "type").select("s", "p", "o")


@register("scan_module_triples", f"SELECT 'urn:module:src/c/c' || c_custkey AS s, '{BASE}dependsOn' AS p, 'urn:module:' || {_MODULE} AS o FROM customer UNION ALL SELECT 'urn:module:src/c/c' || c_custkey, '{T.RDF}type', '{BASE}Module' FROM customer UNION ALL SELECT 'urn:module:src/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '/index' END, '{T.RDF}type', '{BASE}Module' FROM nation")
def scan_module_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return scan.module_quads(files, extract.local_imports(files), G, BASE).select("s", "p", "o")


@register("scan_commit_days", f"SELECT 'urn:session:' || strftime(ts, '%Y-%m-%d') || '-auto' AS s, CAST(count(*) AS VARCHAR) || ' commits' AS title, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE day(ts) > 3 GROUP BY strftime(ts, '%Y-%m-%d')")
def scan_commit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the days that the store doesn't know yet."""
    lines = _table(spark, sf_dir, "events").select(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")).alias("value"))
    days = extract.commit_days(lines)
    held = scan.session_quads(days.filter(F.dayofmonth(F.col("day").cast("date")) <= 3), G, BASE)
    new = scan.session_quads(scan.new_days(days, held, BASE), G, BASE)
    titles, dates = new.filter(F.col("p") == BASE + "title").select("s", F.col("o").alias("title")), new.filter(F.col("p") == BASE + "date").select("s", F.col("o").alias("day"))
    return titles.join(dates, "s")


@register("scan_caps", "SELECT * FROM (VALUES ('files', CAST(20 AS BIGINT)), ('symbols', 30), ('warnings', 2)) v(what, n)")
def scan_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python(spark, sf_dir)
    kept, symbols, warnings = scan.capped(files, extract.python_symbols(files), 20, 30)
    return spark.createDataFrame([("files", kept.count()), ("symbols", symbols.count()), ("warnings", len(warnings))], "what string, n bigint")


# --- the application

V = app.VOCABULARY


def _project(spark: SparkSession, sf_dir: str) -> app.Project:
    """Orders as issues, decisions and to-dos, suppliers as modules, events as sessions."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    s = uri("i", key)
    kind = F.element_at(F.array(*[F.lit(V + x) for x in ("Issue", "Decision", "Todo", "Knowledge", "Insight")]), (key % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("open", "closed", "in-progress"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    lit = lambda p, o, rows=orders, x=s, dt=T.XSD_STRING: rows.select(*quad(G, x, V + p, T.LITERAL, o, dt))
    parts = [orders.select(*quad(G, s, T.RDF + "type", T.IRI, kind)), lit("title", F.concat(F.lit("Order "), key.cast("string"))), lit("date", F.date_format("o_orderdate", "yyyy-MM-dd"), dt=T.XSD_DATE), lit("status", status), lit("priority", F.col("o_orderpriority")), lit("reason", F.col("o_orderpriority"), orders.filter(key % 2 == 0))]
    parts.append(lit("body", F.concat(F.lit("about src/s"), (F.col("o_custkey") % 10).cast("string")), orders.filter(key % 3 == 0)))
    parts.append(orders.select(*quad(G, s, V + "relatedTo", T.IRI, F.concat(F.lit("urn:module:s"), (F.col("o_custkey") % 10).cast("string")))))
    suppliers = _table(spark, sf_dir, "supplier").filter("s_suppkey > 1")
    module = F.concat(F.lit("urn:module:s"), F.col("s_suppkey").cast("string"))
    parts.append(suppliers.select(*quad(G, module, T.RDF + "type", T.IRI, F.lit(V + "Module"))))
    parts.append(suppliers.select(*quad(G, module, V + "dependsOn", T.IRI, F.concat(F.lit("urn:module:s"), F.floor(F.col("s_suppkey") / 2).cast("string")))))
    days = extract.commit_days(_table(spark, sf_dir, "events").select(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("event_type")).alias("value")))
    parts.append(scan.session_quads(days, G, V))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return app.Project(QuadStore(spark, out), G)


_DAY, _STATUS = "strftime(o_orderdate, '%Y-%m-%d')", "['open', 'closed', 'in-progress'][o_custkey % 3 + 1]"


@register("app_open_issues", f"SELECT 'Order ' || o_orderkey AS title, {_DAY} AS date FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 3 = 0 ORDER BY date DESC, 'urn:i:' || o_orderkey LIMIT 10")
def app_open_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).run("open_issues"), {"title": "string", "date": "string"})


@register("app_recent_decisions", f"SELECT 'Order ' || o_orderkey AS title, {_DAY} AS date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS reason FROM orders WHERE o_orderkey % 5 = 1 ORDER BY date DESC, 'urn:i:' || o_orderkey LIMIT 7")
def app_recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).run("recent_decisions", 7), {"title": "string", "date": "string", "reason": "string"})


@register("app_open_todos", f"SELECT 'Order ' || o_orderkey AS title, {_STATUS} AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 5 = 2 AND o_custkey % 3 <> 1 ORDER BY priority DESC, 'urn:i:' || o_orderkey LIMIT 10")
def app_open_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).run("open_todos"), {"title": "string", "status": "string", "priority": "string"})


_SESSIONS = "SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) AS VARCHAR) || ' commits' AS title FROM events GROUP BY 1 ORDER BY date DESC LIMIT {}"


@register("app_recent_sessions", _SESSIONS.format(3))
def app_recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).run("recent_sessions", 3), {"date": "string", "title": "string"})


@register("app_latest_session", _SESSIONS.format(1))
def app_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _project(spark, sf_dir)
    found = to_native(p.run("latest_session"), {"date": "string", "title": "string"})
    day = p.run("last_session_date").df.first().date.lex
    assert p.has_session(day) and not p.has_session("1901-01-01")
    return found.filter(F.col("date") == day)


@register("app_insights", "SELECT 'Order ' || o_orderkey AS title, CAST(NULL AS VARCHAR) AS confidence FROM orders WHERE o_orderkey % 5 = 4 ORDER BY 'urn:i:' || o_orderkey LIMIT 5")
def app_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).run("recent_insights", 5), {"title": "string", "confidence": "string"})


@register("app_domain_activity", "SELECT 'Domain ' || k AS title, n FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) UNION ALL SELECT NULL, CAST(1 AS BIGINT)")
def app_domain_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    session, domain = uri("session", F.col("n_regionkey")), uri("domain", F.col("n_regionkey"))
    parts = [n.select(*quad(G, session, T.RDF + "type", T.IRI, F.lit(V + "Session"))), n.select(*quad(G, session, V + "hasActivity", T.IRI, uri("act", F.col("n_nationkey")))), n.select(*quad(G, session, V + "domain", T.IRI, domain)), n.select(*quad(G, domain, V + "title", T.LITERAL, F.concat(F.lit("Domain "), F.col("n_regionkey").cast("string")), T.XSD_STRING))]
    store = QuadStore(spark)
    store.insert(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    store.insert_turtle(f"<urn:session:x> a <{V}Session> ; <{V}hasActivity> <urn:act:x> .", G)
    return to_native(app.Project(store, G).run("domain_activity"), {"title": "string", "n": "bigint"})


@register("app_search", f"SELECT '{V}' || ['Issue', 'Decision', 'Todo', 'Knowledge', 'Insight'][o_orderkey % 5 + 1] AS kind, 'Order ' || o_orderkey AS title, {_STATUS} AS status FROM orders WHERE o_orderkey % 5 IN (0, 1, 3) AND ((o_orderkey % 3 = 0 AND o_custkey % 10 = 7) OR contains(CAST(o_orderkey AS VARCHAR), '99')) ORDER BY {_DAY} DESC, 'urn:i:' || o_orderkey LIMIT 15")
def app_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).search(["SRC/S7", "99"], limit=15), {"kind": "string", "title": "string", "status": "string"})


@register("app_titles", "SELECT 'Order ' || o_orderkey AS title FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '12') ORDER BY 'urn:i:' || o_orderkey LIMIT 10")
def app_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).titled("12"), {"title": "string"}).filter("title like 'Order%'")


@register("app_counts", f"SELECT '{V}' || ['Issue', 'Decision', 'Todo', 'Knowledge', 'Insight'][o_orderkey % 5 + 1] AS kind, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT '{V}Module', count(*) FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT '{V}Session', count(DISTINCT strftime(ts, '%Y-%m-%d')) FROM events")
def app_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).counts(), {"kind": "string", "n": "bigint"})


@register("app_impact", "SELECT 'dependent' AS what, 'urn:module:s' || s_suppkey AS x FROM supplier WHERE s_suppkey // 2 = 3 AND s_suppkey > 1 UNION ALL SELECT 'dependency', 'urn:module:s1' UNION ALL SELECT 'impact', CASE WHEN count(*) = 0 THEN 'low' WHEN count(*) <= 3 THEN 'medium' ELSE 'high' END FROM supplier WHERE s_suppkey // 2 = 3 AND s_suppkey > 1")
def app_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _project(spark, sf_dir).impact("s3.ts")
    return spark.createDataFrame([("dependent", x) for x in found["dependents"]] + [("dependency", x) for x in found["dependencies"]] + [("impact", found["impact"])], "what string, x string")


@register("app_related", f"SELECT '{V}' || ['Issue', 'Decision', 'Todo', 'Knowledge', 'Insight'][o_orderkey % 5 + 1] AS kind, 'Order ' || o_orderkey AS title, {_STATUS} AS status, {_DAY} AS date FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 10 = 4 ORDER BY 'urn:i:' || o_orderkey LIMIT 10")
def app_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).related("src/s4"), {"kind": "string", "title": "string", "status": "string", "date": "string"})


@register("app_transitive", "WITH RECURSIVE c(m) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey // 2 = 2 AND s_suppkey > 1 UNION SELECT s.s_suppkey FROM c JOIN supplier s ON s.s_suppkey // 2 = c.m AND s.s_suppkey > 1) SELECT 'urn:module:s' || m AS x FROM c")
def app_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).transitive_dependents("s2"), {"x": "string"})


@register("app_details", f"SELECT '{T.RDF}type' AS p, '{V}Module' AS o UNION ALL SELECT '{V}dependsOn', 'urn:module:s4'")
def app_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_native(_project(spark, sf_dir).details("urn:module:s9"), {"p": "string", "o": "string"})


@register("app_predicates", "SELECT 'Module.hasOpenIssue' AS name, count(*) > 0 AS answer, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 3 = 0 AND o_custkey % 10 = 4 UNION ALL SELECT 'Module.hasDependents', true, CAST(2 AS BIGINT) UNION ALL SELECT 'Decision.exists', true, CAST(0 AS BIGINT) UNION ALL SELECT 'Knowledge.exists', count(*) > 0, least(count(*), 10) FROM orders WHERE o_orderkey % 5 = 3 AND contains('order ' || o_orderkey, 'r 1') UNION ALL SELECT 'Issue.isResolved', false, CAST(0 AS BIGINT) UNION ALL SELECT 'unknown', NULL, CAST(0 AS BIGINT) UNION ALL SELECT 'own', true, CAST(1 AS BIGINT) UNION ALL SELECT 'missing', NULL, CAST(1 AS BIGINT)")
def app_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates built in and one that the store describes; parameters that are missing; an evaluation is recorded."""
    p = _project(spark, sf_dir)
    p.store.insert_turtle(f'<urn:predicate:own> a <{V}Predicate> ; <{V}title> "own" ; <{V}sparqlTemplate> "SELECT ?x WHERE {{ GRAPH <{{{{graphUri}}}}> {{ ?x a <{V}Module> FILTER(?x = <urn:module:{{{{which}}}}>) }} }}" ; <{V}requiredParam> "which" .', G)
    asked = {"Module.hasOpenIssue": {"module": "s4"}, "Module.hasDependents": {"module": "s4"}, "Decision.exists": {"keyword": "ORDER"}, "Knowledge.exists": {"keyword": "R 1"}, "Issue.isResolved": {"issue": "urn:i:none"}, "unknown": {}, "own": {"which": "s9"}}
    rows = []
    for name, parameters in asked.items():
        out = p.ask(name, record=name == "own", **parameters)
        rows.append((name, out["answer"], len(out["rows"])))
    out = p.ask("Decision.exists")
    rows.append(("missing", out["answer"], len(out["missing"])))
    assert p.store.ask("ASK { ?e a v:Evaluation ; v:predicate \"own\" ; v:result \"true\" }", G)
    return spark.createDataFrame(rows, "name string, answer boolean, n bigint")
