"""Which side of a join moves, and what isn't read: plans that results alone don't show."""

import json

from pyspark.sql import functions as F
from quadloom.functions import terms as T
from quadloom.operators import scan, shacl
from quadloom.operators.store import QuadStore
from quadloom.sources import turtle
from quadloom.sources.mapping import BASE, shop

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_shapes_are_never_broadcast(spark):
    shapes = f"@prefix sh: <{shacl.SH}> . @prefix : <{BASE}> . :S sh:targetClass :Part ; sh:closed true ; sh:property [ sh:path :p_size ; sh:lessThan :p_retailprice ; sh:equals :p_size ; sh:minCount 1 ] ."
    found = plan(shacl.validate(shop(spark, SMALL, ["part"]), shapes))
    assert "BroadcastHashJoin [n_kind" not in found and "BroadcastHashJoin [cast(n_kind" not in found and "SortMergeJoin [n_kind" in found


def test_a_small_insert_leaves_the_store_where_it_is(spark):
    store = QuadStore(spark, shop(spark, SMALL, ["customer", "orders"], "g"))
    before = store.quads.count()
    new = turtle.quads(spark, f'@prefix : <{BASE}> . <urn:customer:1> :c_mktsegment "new" .', "g")
    held = plan(store._held(["g"], new))
    assert held.count("FileScan") == 1 and "SortMergeJoin" not in held
    store.insert(new.unionByName(store.quads.filter((F.col("s") == "urn:order:1") & (F.col("p") == T.RDF + "type"))))
    assert store.quads.count() == before + 1


def test_snapshots_are_cut_as_one_is(spark):
    facts = {"entryPoints": [{"path": "a", "content": "x\n" * 400}], "readme": "r\n" * 200, "directoryTree": [{"path": f"a/b/{k}", "depth": 3} for k in range(10)] + [{"path": "a", "depth": 2}], "detectedImports": ["p"] * 5, "dependencyGraph": {"edges": []}}
    reports = spark.createDataFrame([(1, json.dumps(facts)), (2, "{}")], "key long, facts string")
    rows = {(r.key, r.bytes): json.loads(r.report) for r in scan.snapshots(reports, [100_000, 1200, 60]).collect()}
    assert rows == {(key, most): scan.snapshot(f, most) for key, f in ((1, facts), (2, {})) for most in (100_000, 1200, 60)}
