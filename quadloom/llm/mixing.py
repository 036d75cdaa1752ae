"""Mixing sources to target weights in fixed-length blocks.

The words of each source, in an order fixed by hashes, are one long stream cut into blocks of
BLOCK words. The mix is a sequence of slots, dealt to output shards of SHARD_SLOTS each. How many
slots of a shard fall to each source is a multinomial draw on what is left of the sources' quotas:
a range of shards is halved again and again, and each half's counts are drawn by a generator seeded
with the range, so any task finds the counts of its shards, and how often each source came up
before them, without the other tasks. The i-th slot of a source takes block perm(i mod blocks),
perm being a pseudorandom permutation of the source's block numbers with a key for each pass, so a
source is used up evenly, pass after pass. Slots and document segments then meet by an equi-join on
(source, block).

Targets: sources by code point (null last) weigh 5, 2, 1 and so on again, and share all words; a
target stops at MOST times its source's words and the excess is shared again by weight.

Nothing is gathered but one row for each source. A source's stream is laid out by sums over hash
buckets of about BUCKET_ROWS documents, so a source with a third of all rows is spread like others.

Defined results: null and blank texts have size 0 and are never taken; repeated rows are documents
of their own; a null source is a source; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import WORD, checkpointed, mix64, shuffle_partitions

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 1024
SHARD_SLOTS = 4096
BUCKET_ROWS = 4096
SEED = 11


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words to take of each source, given its words; sources stand in order of code points."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = {i for i, n in enumerate(sizes) if n > 0}
    left = total
    while free:
        whole = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / whole for i in free}
        full = [i for i in free if share[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def quotas(sizes: list[int], goal: list[float], block: int, most: int = MOST) -> list[int]:
    """Slots of each source: its target in blocks of its own mean length, at most `most` passes."""
    blocks = [-(-n // block) for n in sizes]
    return [min(most * b, round(g * b / n)) if n else 0 for n, b, g in zip(sizes, blocks, goal)]


def halve(quota: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of so many slots, kept to what the quotas hold."""
    total = int(quota.sum())
    if slots >= total:
        return quota.copy()
    drawn = np.minimum(rng.multinomial(slots, quota / total), quota)
    # A draw may ask more of a source than is left; what it lacks is drawn from the rest.
    while (short := slots - int(drawn.sum())) > 0:
        room = quota - drawn
        drawn += np.minimum(rng.multinomial(short, room / room.sum()), room)
    return drawn


def shard_counts(quota: np.ndarray, shards: int, slots: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards first..last: number, slots by source, and slots by source in all shards before it."""
    todo = [(0, shards, quota, np.zeros_like(quota))]
    while todo:
        low, high, own, before = todo.pop()
        if high <= first or low > last:
            continue
        if high - low == 1:
            yield low, own, before
            continue
        middle = (low + high) // 2
        left = halve(own, (middle - low) * slots, np.random.default_rng([seed, low, high]))
        todo.append((middle, high, own - left, before + left))
        todo.append((low, middle, left, before))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 by key: a Feistel network on enough bits, walked until inside."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    half = np.maximum(half, np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m = half[todo], mask[todo]
        a, b = out[todo] >> h, out[todo] & m
        for turn in range(4):
            a, b = b, a ^ (mix64(b + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _laid_out(docs: DataFrame) -> DataFrame:
    """One row a document: its source key, size, and where its words begin in its source's stream."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    thin = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")).alias("skey"), size.alias("size"), F.xxhash64("text").alias("tie"))
    thin = checkpointed(thin)
    buckets = max(1, -(-thin.count() // BUCKET_ROWS))
    thin = thin.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = thin.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("skey", "bucket", (F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return checkpointed(thin.withColumn("inside", inside).join(before, ["skey", "bucket"]).select("doc_id", "skey", "size", (F.col("before") + F.col("inside")).alias("begin")))


def mixed(docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents laid out, sources, slots).

    documents: doc_id, skey, size, begin. sources: skey, source_size, target, blocks.
    slots: shard, slot, skey, block, turn (how often the source has been gone through before).
    """
    spark = docs.sparkSession
    laid = _laid_out(docs)
    per_source = laid.groupBy("skey").agg(F.sum("size").alias("n")).collect()  # one row a source
    rows = sorted((r for r in per_source), key=lambda r: (r.skey == "~", r.skey))
    sizes = [int(r.n) for r in rows]
    goal = targets(sizes, weights, most)
    quota = np.array(quotas(sizes, goal, block, most), np.int64)
    blocks = np.array([max(1, -(-n // block)) for n in sizes], np.int64)
    sources = spark.createDataFrame([(r.skey, n, g, int(b)) for r, n, g, b in zip(rows, sizes, goal, blocks)], "skey string, source_size long, target double, blocks long")
    shards = max(1, -(-int(quota.sum()) // shard_slots))
    names = np.array([r.skey for r in rows], object)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(quota):
                continue
            for shard, counts, before in shard_counts(quota, shards, shard_slots, int(batch["id"].min()), int(batch["id"].max()), seed):
                source = np.repeat(np.arange(len(quota)), counts)
                if not len(source):
                    continue
                draw = before[source] + np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
                turn = draw // blocks[source]
                at = permuted(draw % blocks[source], blocks[source], turn * len(quota) + source + seed)
                place = np.random.default_rng([seed, shard]).permutation(len(source))
                yield pd.DataFrame({"shard": shard, "slot": place, "skey": names[source], "block": at, "turn": turn})

    parts = min(shards, shuffle_partitions(spark))
    slots = spark.range(0, shards, 1, parts).mapInPandas(deal, "shard long, slot long, skey string, block long, turn long")
    return laid, sources, slots


def segments(laid: DataFrame, block: int) -> DataFrame:
    """Which words of which documents lie in which block: skey, block, begin (of the document), from_word, words."""
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    cut = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest("begin", F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("skey", "block", "begin", "doc_id", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))


def blocks_of(laid: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The mix itself: for each slot the runs of words that fill it."""
    return slots.join(segments(laid, block).hint("merge"), ["skey", "block"])


def taken_by_source(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """doc_id, skey, size, source_size, target, taken of each document."""
    laid, sources, slots = mixed(docs, block, **options)
    # How often each block was drawn, before it meets the documents in it.
    drawn = slots.groupBy("skey", "block").agg(F.count("*").alias("times"))
    # Both sides grow with the corpus; Spark takes what comes of a short range for small and would broadcast it.
    per_doc = segments(laid, block).hint("merge").join(drawn, ["skey", "block"]).groupBy("skey", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("got"))
    some = laid.filter("size > 0").hint("merge").join(per_doc, ["skey", "begin"], "left")
    rows = some.unionByName(laid.filter("size = 0").withColumn("got", F.lit(0).cast("long")))
    return rows.join(sources, "skey").select("doc_id", "skey", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def taken(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return taken_by_source(docs, block, **options).drop("skey")


#: Fixed point for sums of fractions, so that sums in any order agree to the last bit.
ONE = 1 << 20


def copies(rows: DataFrame) -> DataFrame:
    """doc_id, skey, copies: rows of taken_by_source rounded to whole documents, source by source.

    A document that is taken x times over gets floor(x) or floor(x) + 1 copies: x is cumulated along
    the source, rounded, and differenced. Rounding is never off by more than half a document, so
    with documents in order of size the words are off by one longest document at most. The order is
    that of size classes, of hash buckets inside them, and of size inside those; each bucket more
    than one a class (there is one for every BUCKET_ROWS documents) can add its class's size.
    Rows equal in doc_id and skey are one document.
    """
    items = rows.groupBy("doc_id", "skey").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).filter("taken > 0")
    items = checkpointed(items.select("doc_id", "skey", "size", F.expr(f"(taken * {ONE} + size div 2) div size").alias("x")))
    buckets = max(1, -(-items.count() // BUCKET_ROWS))
    items = items.withColumn("class", F.floor(F.log2("size"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    group = ["skey", "class", "bucket"]
    sums = items.groupBy(group).agg(F.sum("x").alias("all"))
    before = sums.select(*group, (F.sum("all").over(Window.partitionBy("skey").orderBy("class", "bucket")) - F.col("all")).alias("before"))
    inside = F.sum("x").over(Window.partitionBy(group).orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    upto = items.withColumn("inside", inside).join(before, group).withColumn("upto", F.col("before") + F.col("inside") + ONE // 2)
    return upto.select("doc_id", "skey", F.expr(f"cast(upto div {ONE} - (upto - x) div {ONE} as int)").alias("copies"))
