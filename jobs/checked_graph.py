"""Checked graphs of ordinary tables: map, validate, set aside what violates, infer, write by graph.

For each graph of the config the tables named are read as quads (quadloom.sources.mapping), checked
against the SHACL shapes, and split: subjects with a violation are rejected with all their quads,
the rest is accepted and gets what RDFS lets conclude from the vocabulary. The rows go to <output>,
partitioned by graph: state ('graph', 'accepted', 'rejected', 'violation' or 'inferred'), the triple,
and a note (of a violation the component, of an inferred triple the rule). A run overwrites the
partitions of its own graphs and no others, so it can be repeated, as a whole or graph by graph,
with the same result; a graph whose tables are empty keeps its one 'graph' row.

    python -m jobs.checked_graph jobs/checked_graph.json --set input=/data/tables --set output=/data/graphs
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings
from quadloom.functions import terms as T
from quadloom.operators import rdfs, shacl
from quadloom.plans.fixpoint import checkpointed
from quadloom.sources import turtle
from quadloom.sources.mapping import BASE, shop

DEFAULTS = {
    "input": None,
    "output": None,
    "graphs": {"documents": ["documents", "labels"], "customers": ["customer", "nation"]},
    "prefixes": f"@prefix : <{BASE}> . @prefix rdfs: <{T.RDFS}> . @prefix sh: <{shacl.SH}> . @prefix xsd: <{T.XSD}> .",
    "vocabulary": ":Doc rdfs:subClassOf :Text . :Text rdfs:subClassOf :Thing . :source rdfs:subPropertyOf :origin . :quality rdfs:domain :Judged . :Customer rdfs:subClassOf :Party . :nation rdfs:subPropertyOf :place ; rdfs:range :Country .",
    "shapes": ":DocShape a sh:NodeShape ; sh:targetClass :Doc ; sh:property [ sh:path :source ; sh:minCount 1 ; sh:message 'no source' ] ; sh:property [ sh:path :quality ; sh:minInclusive 1 ; sh:message 'poor' ] ; sh:property [ sh:path :toxic ; sh:maxInclusive 0 ; sh:message 'toxic' ] . :CustomerShape a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :c_acctbal ; sh:minInclusive 0 ; sh:message 'below zero' ] .",
}
COLUMNS = ["g", "state", "s", "p", "o_kind", "o", "o_dt", "note"]


def _rows(df: DataFrame, graph: str, state: str | Column, note: Column) -> DataFrame:
    return df.select(F.lit(graph).alias("g"), (F.lit(state) if isinstance(state, str) else state).alias("state"), "s", "p", F.col("o_kind").cast("int").alias("o_kind"), "o", "o_dt", note.alias("note"))


def graph_rows(spark: SparkSession, config: dict, graph: str, tables: list[str]) -> DataFrame:
    """Everything that is written for one graph."""
    data = shop(spark, config["input"], tables)
    vocabulary = turtle.quads(spark, f"{config['prefixes']} {config['vocabulary']}", "")
    # Thin rows that everything below joins with: worked out once.
    found = checkpointed(shacl.validate(data, f"{config['prefixes']} {config['shapes']}"))
    bad = found.select(F.col("focus_node").alias("s")).distinct()
    # Each quad moves once, to be told accepted or rejected; inference reads the few predicates that it needs.
    state = F.when(F.col("bad"), "rejected").otherwise("accepted")
    told = data.join(bad.withColumn("bad", F.lit(True)), "s", "left").withColumn("state", state)
    inferred = rdfs.infer(data.join(bad, "s", "left_anti").unionByName(vocabulary))
    itself = spark.range(1).select(F.lit(graph).alias("s"), F.lit(T.RDF + "type").alias("p"), F.lit(T.IRI).alias("o_kind"), F.lit(BASE + "Graph").alias("o"), F.lit("").alias("o_dt"))
    violations = found.select(F.col("focus_node").alias("s"), F.col("path").alias("p"), F.lit(T.LITERAL).alias("o_kind"), F.col("message").alias("o"), F.lit(T.XSD_STRING).alias("o_dt"), "component")
    parts = [
        _rows(itself, graph, "graph", F.lit("")),
        _rows(told, graph, F.col("state"), F.lit("")),
        _rows(violations, graph, "violation", F.col("component")),
        _rows(inferred, graph, "inferred", F.col("rule")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run(spark: SparkSession, config: dict) -> dict[str, dict[str, int]]:
    """Write every graph of the config; returns rows by graph and state."""
    config = DEFAULTS | config
    counts: dict[str, dict[str, int]] = {}
    for name, tables in config["graphs"].items():
        graph = f"urn:graph:{name}"
        with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            graph_rows(spark, config, graph, tables).write.mode("overwrite").partitionBy("g").parquet(config["output"])
        written = spark.read.parquet(config["output"]).filter(F.col("g") == graph).groupBy("state").count().collect()  # five states at most
        counts[graph] = {r.state: r["count"] for r in sorted(written, key=lambda r: r.state)}
        log.info("checked_graph: read %s from %s, wrote %s: %s", ", ".join(tables), config["input"], graph, counts[graph])
    return counts


if __name__ == "__main__":
    main(run, "checked_graph", DEFAULTS)
