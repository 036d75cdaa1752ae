"""Incremental loading: a file stream of Turtle upserted into a Parquet quad table.

Files are read once (the stream's checkpoint remembers them) and each micro-batch is merged by quad,
so loading a file again changes nothing. Blank nodes are those of their file's path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.store import KEY
from quadloom.plans.compiler import QUADS
from quadloom.sources import turtle


def upsert(spark: SparkSession, batch: DataFrame, table: str) -> None:
    """Append the quads of a batch that the table doesn't hold."""
    new = batch.dropDuplicates(KEY)
    try:
        held = spark.read.schema(QUADS).parquet(table)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], QUADS)
    graphs = [r.g for r in new.select("g").distinct().collect()]  # one row a graph of the batch
    new.join(held.filter(F.col("g").isin(*graphs)), KEY, "left_anti").write.mode("append").partitionBy("g").parquet(table)


def load_stream(spark: SparkSession, folder: str, table: str, graph: str, checkpoint: str):
    """Loads what is new in a folder, then stops. Returns the streaming query."""
    source = spark.readStream.format("text").option("wholetext", True).load(folder).select("value", F.col("_metadata.file_path").alias("path"))

    def merge(batch: DataFrame, _: int) -> None:
        def parse(frames):
            import pandas as pd

            for frame in frames:
                for text, path in zip(frame["value"], frame["path"]):
                    triples, _ = turtle.parse(text, path)
                    yield pd.DataFrame([(graph, *t, False) for t in triples], columns=["g", *turtle.FIELDS, "inferred"])

        upsert(spark, batch.mapInPandas(parse, QUADS), table)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
