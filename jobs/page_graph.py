"""Incremental graph of crawled pages: class, title and links of each page as quads, one graph a host.

Pages come as Parquet files in a folder. A run takes the files that its checkpoint doesn't know
(a file stream with availableNow), so running it again without new files writes nothing. Quads go
to <output>/quads, partitioned by micro-batch and by bucket of the host. A batch writes only what
earlier batches don't hold, and it overwrites its own partitions, so a batch that is tried again
leaves what it would have left the first time. <output>/batches tells what each batch read and wrote.

A page is named by its URL less the fragment. Links are double-quoted hrefs: absolute ones stay,
those that begin with / or // are completed from the page's URL; others (fragments, scripts, mail)
are left out, and so are rows whose URL is null or has no host. The title is the text of the first
title element as it stands. Null html gives the class only; repeated rows and pages met again add
what is new of them.

    python -m jobs.page_graph jobs/page_graph.json --set source='/data/pages/*.parquet' --set output=/data/graph
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobs.common import log, main, settings
from quadloom.functions import terms as T
from quadloom.operators.extract import links
from quadloom.operators.store import KEY
from quadloom.sources.mapping import quad

SCHEMA = "page_id long, url string, html string"
DEFAULTS = {"source": None, "output": None, "checkpoint": None, "vocabulary": "http://example.org/web#", "buckets": 64, "files_per_batch": 1000}
_HOST = r"^https?://([^/?#]+)"


def page_quads(pages: DataFrame, vocabulary: str) -> DataFrame:
    """Quads of pages, and each one's host."""
    rows = pages.select(F.regexp_replace("url", "#.*$", "").alias("page_id"), "html").withColumn("host", F.regexp_extract("page_id", _HOST, 1)).filter("host <> ''")
    title = F.regexp_extract("html", "(?s)<title[^>]*>([^<]*)", 1)
    found = links(rows).select("page_id", F.regexp_replace("href", "#.*$", "").alias("href"), F.regexp_extract("page_id", _HOST, 1).alias("host"))
    scheme = F.regexp_extract("page_id", "^(https?:)", 1)
    target = (
        F.when(F.col("href").rlike("^https?://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, "href"))
        .when(F.col("href").startswith("/"), F.concat(scheme, F.lit("//"), "host", "href"))
    )
    s = F.col("page_id")
    parts = [
        rows.select("host", *quad("", s, T.RDF + "type", T.IRI, F.lit(vocabulary + "Page"))),
        rows.filter(title != "").select("host", *quad("", s, vocabulary + "title", T.LITERAL, title, T.XSD_STRING)),
        found.filter(target.isNotNull()).select("host", *quad("", s, vocabulary + "linksTo", T.IRI, target)),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumn("g", F.concat(F.lit("urn:host:"), "host"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run(spark: SparkSession, config: dict) -> int:
    """Take in what is new; returns how many batches there were."""
    config = DEFAULTS | config
    quads_path, log_path = f"{config['output']}/quads", f"{config['output']}/batches"
    done = []

    def write(pages: DataFrame, batch: int) -> None:
        session = pages.sparkSession
        bucket = F.pmod(F.xxhash64("host"), F.lit(config["buckets"])).cast("int")
        rows = page_quads(pages, config["vocabulary"]).withColumn("bucket", bucket).drop("host").dropDuplicates(KEY).withColumn("batch", F.lit(batch).cast("long"))
        stored = lambda: session.read.schema(rows.schema).parquet(quads_path)
        new = rows
        if _exists(session, quads_path):  # not before the first batch
            new = rows.join(stored().filter(F.col("batch") < batch).select("bucket", *KEY), ["bucket", *KEY], "left_anti")
        with settings(session, spark__sql__sources__partitionOverwriteMode="dynamic"):
            new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("batch", "bucket").parquet(quads_path)
            written = stored().filter(F.col("batch") == batch).agg(F.count("*").alias("quads"), F.count_distinct("g").alias("hosts")).first()
            counts = (batch, pages.count(), written.quads, written.hosts)
            session.createDataFrame([counts], "batch long, pages long, quads long, hosts long").write.mode("overwrite").partitionBy("batch").parquet(log_path)
        log.info("page_graph batch %d: read %d pages, wrote %d new quads of %d hosts", *counts)
        done.append(batch)

    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(config["source"])
    stream: StreamingQuery = source.writeStream.foreachBatch(write).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("page_graph: %d new batches from %s", len(done), config["source"])
    return len(done)


if __name__ == "__main__":
    main(run, "page_graph", DEFAULTS)
