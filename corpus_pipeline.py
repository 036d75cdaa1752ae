"""A corpus pipeline: poor and toxic documents go, near-duplicates go, sources are mixed, the rest is packed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import jaccard, mixing, packing, quality, toxicity
from quadloom.llm.common import shared_folder, table
from quadloom.llm.queries import MIX_BLOCK, tokenizer_path


def _kept(docs: DataFrame, scored: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """Rows of docs whose score meets the condition, as they were: their own columns of any name included."""
    return scored(docs.select(F.struct("*").alias("_row"), "text")).filter(keep).select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores under the threshold go.

    Null, empty and blank texts are judged by the model's bias; equal texts, repeated rows among
    them, get equal scores and stay or go together; texts are scored whole; an empty table stays
    empty; without labelled rows all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: quality.score(rows, model), "predicted = 1")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity scores at the threshold or over it go.

    Null, empty and blank texts are judged by the model's biases; otherwise as for quality.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: toxicity.score(rows, model), "predicted = 0")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one of the smallest doc_id stays.

    Rows that repeat a doc_id are one document and leave one row. Rows without a doc_id stay, and so
    do those without words, which are linked with nothing. Long texts are compared whole; an empty
    table stays empty; columns of any name stay as they are.
    """
    found = jaccard.joined(docs, n=5, num=80, den=100)
    gone = found.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return kept
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; documents that it never takes go.

    A document of which the mix takes x times its words is returned floor(x) or floor(x) + 1 times.
    Which of them is settled along each source (mixing.copies), so the words of a source stay within
    about one document of what the mix takes. Rows equal in doc_id, source and text are one document.
    Null and blank texts have no words and go; a null source is a source; ties in size are settled
    by doc_id; an empty table stays empty; columns of any name stay as they are.
    """
    key = F.struct("doc_id", F.xxhash64("source", "text").alias("tie"))
    mix = mixing.copies(mixing.taken_by_source(docs.withColumn("doc_id", key), MIX_BLOCK))
    copies = mix.filter("copies > 0").select(F.col("doc_id").alias("_doc"), F.col("copies").alias("_copies"))
    met = docs.select(F.struct("*").alias("_row"), key.alias("_doc")).join(copies, "_doc")
    return met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; null and empty texts are the one token that ends a document."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Classifiers and token ids are beyond SQL; tests hold deduplication and mixing against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again as the next one's."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
