"""What the two text classifiers share: a bounded training sample, and scoring by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import let_go, small_batches
from quadloom.llm.subword import Model


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[list, list, float | None]:
    """Texts and labels of at most per_class labelled rows of each class, the same ones each time,
    and the share of label 1 among all rows that learn admits (null without both classes).

    learn filters the labelled rows by doc_id. Rows are ordered by a hash of doc_id. The hash
    order runs over thin rows and keeps per_class of them in each task before any shuffle, and
    only the chosen ids (at most 2 * per_class) are broadcast to fetch texts.
    """
    thin = labels.filter(learn & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null")
    thin = thin.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for k in (0, 1):
        part = thin.filter(F.col("y") == k).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.doc_id))
    counts = {r.y: r["count"] for r in thin.groupBy("y").count().collect()}  # two rows at most
    return [r.text for r in rows], [r.y for r in rows], counts[1] / sum(counts.values()) if len(counts) == 2 else None


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score of each text; narrow, one pass, no shuffle."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = replace(held.value, cache={})  # words kept for one task, not for the life of the worker
        for texts in batches:
            yield pd.Series(own.scores(texts.tolist()))
        let_go()

    return docs.withColumn(score, score_of(F.col("text")))
