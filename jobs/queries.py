"""The jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import checked_graph, page_graph
from quadloom.functions import terms as T
from quadloom.sources.mapping import BASE


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir; of this machine where that is unset and Spark runs on it alone."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='jobs')}/{name}-{uuid.uuid4().hex}"


def job1_page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "page_graph")
    # As a pattern, since a stream's source is a folder or a pattern, never one file.
    config = {"source": f"{sf_dir}/pages.parque[t]", "output": f"{folder}/out", "checkpoint": f"{folder}/checkpoint"}
    for _ in range(2):
        page_graph.run(spark, config)
    return spark.read.parquet(f"{folder}/out/quads").select("g", "s", "p", F.col("o_kind").cast("int").alias("o_kind"), "o", "o_dt")


def job2_checked_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "checked_graph")
    for _ in range(2):
        checked_graph.run(spark, {"input": sf_dir, "output": folder})
    return spark.read.parquet(folder).select(*checked_graph.COLUMNS)


QUERIES = {"job1_page_graph": job1_page_graph, "job2_checked_graph": job2_checked_graph}

_WEB = page_graph.DEFAULTS["vocabulary"]

JOB1_SQL = f"""
WITH p AS (
  SELECT regexp_replace(url, '#.*$', '') AS s, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?:)', 1) AS scheme FROM pages
), links AS (
  SELECT s, host, scheme, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '#.*$', '') AS href FROM p
)
SELECT DISTINCT 'urn:host:' || host AS g, s, p, CAST(o_kind AS INTEGER) AS o_kind, o, o_dt FROM (
  SELECT host, s, '{T.RDF}type' AS p, 0 AS o_kind, '{_WEB}Page' AS o, '' AS o_dt FROM p
  UNION ALL SELECT host, s, '{_WEB}title', 2, regexp_extract(html, '<title[^>]*>([^<]*)', 1), '{T.XSD_STRING}' FROM p WHERE regexp_extract(html, '<title[^>]*>([^<]*)', 1) <> ''
  UNION ALL SELECT host, s, '{_WEB}linksTo', 0, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN scheme || href ELSE scheme || '//' || host || href END, ''
    FROM links WHERE regexp_matches(href, '^(https?://|/)')
) WHERE host <> ''
"""

_DOCS, _PEOPLE, _TYPE = "urn:graph:documents", "urn:graph:customers", T.RDF + "type"
_LITERALS = {"documents": [("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer")], "labels": [("quality", "integer"), ("toxic", "integer")], "customer": [("c_name", "string"), ("c_acctbal", "double"), ("c_mktsegment", "string")], "nation": [("n_name", "string")]}


def _sql_literals(g: str, kind: str, key: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS g, 'urn:{kind}:' || {key} AS s, '{BASE}{c}' AS p, 2 AS o_kind, CAST({c} AS VARCHAR) AS o, '{T.XSD}{dt}' AS o_dt FROM {table} WHERE {c} IS NOT NULL" for c, dt in _LITERALS[table])


def _sql_iri(g: str, s: str, p: str, o: str, source: str) -> str:
    return f"SELECT '{g}' AS g, {s} AS s, '{p}' AS p, 0 AS o_kind, {o} AS o, '' AS o_dt FROM {source}"


JOB2_SQL = f"""
WITH data AS (
  {_sql_iri(_DOCS, "'urn:doc:' || doc_id", _TYPE, f"'{BASE}Doc'", "documents")}
  UNION ALL {_sql_literals(_DOCS, "doc", "doc_id", "documents")} UNION ALL {_sql_literals(_DOCS, "doc", "doc_id", "labels")}
  UNION ALL {_sql_iri(_PEOPLE, "'urn:customer:' || c_custkey", _TYPE, f"'{BASE}Customer'", "customer")}
  UNION ALL {_sql_literals(_PEOPLE, "customer", "c_custkey", "customer")}
  UNION ALL {_sql_iri(_PEOPLE, "'urn:customer:' || c_custkey", BASE + "nation", "'urn:nation:' || c_nationkey", "customer WHERE c_nationkey IS NOT NULL")}
  UNION ALL {_sql_iri(_PEOPLE, "'urn:nation:' || n_nationkey", _TYPE, f"'{BASE}Nation'", "nation")}
  UNION ALL {_sql_literals(_PEOPLE, "nation", "n_nationkey", "nation")}
  UNION ALL {_sql_iri(_PEOPLE, "'urn:nation:' || n_nationkey", BASE + "region", "'urn:region:' || n_regionkey", "nation WHERE n_regionkey IS NOT NULL")}
), violations AS (
  SELECT '{_DOCS}' AS g, 'urn:doc:' || doc_id AS s, '{BASE}source' AS p, 'no source' AS o, 'MinCountConstraintComponent' AS note FROM documents WHERE source IS NULL
  UNION ALL SELECT '{_DOCS}', 'urn:doc:' || doc_id, '{BASE}quality', 'poor', 'MinInclusiveConstraintComponent' FROM labels JOIN documents USING (doc_id) WHERE quality < 1
  UNION ALL SELECT '{_DOCS}', 'urn:doc:' || doc_id, '{BASE}toxic', 'toxic', 'MaxInclusiveConstraintComponent' FROM labels JOIN documents USING (doc_id) WHERE toxic > 0
  UNION ALL SELECT '{_PEOPLE}', 'urn:customer:' || c_custkey, '{BASE}c_acctbal', 'below zero', 'MinInclusiveConstraintComponent' FROM customer WHERE c_acctbal < 0
), sides AS (
  SELECT *, EXISTS (SELECT 1 FROM violations v WHERE v.g = data.g AND v.s = data.s) AS bad FROM data
), good AS (
  SELECT * FROM sides WHERE NOT bad
), inferred AS (
  SELECT g, s, p, o_kind, o, o_dt, min(note) AS note FROM (
    SELECT g, s, p, o_kind, unnest(CASE o WHEN '{BASE}Doc' THEN ['{BASE}Text', '{BASE}Thing'] WHEN '{BASE}Customer' THEN ['{BASE}Party'] ELSE [] END) AS o, o_dt, 'rdfs9' AS note FROM good WHERE p = '{_TYPE}'
    UNION ALL SELECT g, s, '{BASE}origin', o_kind, o, o_dt, 'rdfs7' FROM good WHERE p = '{BASE}source'
    UNION ALL SELECT g, s, '{BASE}place', o_kind, o, o_dt, 'rdfs7' FROM good WHERE p = '{BASE}nation'
    UNION ALL SELECT g, s, '{_TYPE}', 0, '{BASE}Judged', '', 'rdfs2' FROM good WHERE p = '{BASE}quality'
    UNION ALL SELECT g, o, '{_TYPE}', 0, '{BASE}Country', '', 'rdfs3' FROM good WHERE p = '{BASE}nation'
    UNION ALL SELECT g, '{BASE}Doc', '{T.RDFS}subClassOf', 0, '{BASE}Thing', '', 'rdfs11' FROM (VALUES ('{_DOCS}'), ('{_PEOPLE}')) v(g)
  ) GROUP BY ALL
)
SELECT g, state, s, p, CAST(o_kind AS INTEGER) AS o_kind, o, o_dt, note FROM (
  SELECT g, 'graph' AS state, g AS s, '{_TYPE}' AS p, 0 AS o_kind, '{BASE}Graph' AS o, '' AS o_dt, '' AS note FROM (VALUES ('{_DOCS}'), ('{_PEOPLE}')) v(g)
  UNION ALL SELECT g, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END, s, p, o_kind, o, o_dt, '' FROM sides
  UNION ALL SELECT g, 'violation', s, p, 2, o, '{T.XSD_STRING}', note FROM violations
  UNION ALL SELECT g, 'inferred', s, p, o_kind, o, o_dt, note FROM inferred
)
"""

ORACLES = {"job1_page_graph": JOB1_SQL, "job2_checked_graph": JOB2_SQL}
