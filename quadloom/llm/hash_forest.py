"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are hashed to long bit strings by signs of random projections, another set for each tree.
A tree is the sorted array of its strings. A query descends each tree to its longest matching
prefix, then all trees ascend together, one bit at a time, so that at each level every tree adds
the vectors that share that many leading bits, until enough candidates are found. Candidates are
scored exactly, in double precision.

The table is dealt into shards of about SHARD_ROWS distinct vectors. A shard has one forest, built
once, through which all queries stream, so a task holds one shard and one batch of queries. The
nearest of each shard are merged by query. Equal vectors are one entry with its smallest ids: of n
equal vectors no query can need more than the k + 1 smallest, so the rest are not lost to it.

How many candidates are enough is measured, not set: SAMPLE queries, or all if fewer, are answered
exactly, and the share of a shard that has to be met so that SURE of their neighbours are met (more
are, as queries end with whole levels) is what each query scores. The closer the neighbours are
compared with other vectors, the smaller it is, so it falls as the table grows, and far more where vectors have structure.

For inner products of vectors of unequal length, each vector gets a coordinate that makes all
lengths equal (queries get 0 there), which leaves products as they are and lets angles rank them.

Defined results: null and zero vectors, and those with null or non-finite components, take no part,
neither do those of another length than most distinct vectors' (the greater length wins ties); ties
go to the smaller id; a null id takes no part; rows that repeat an id and its vector are one row; of
an id's several vectors the best counts as a candidate, and the one of the smallest hash asks; with
fewer candidates than k, all of them are returned; very long vectors are used whole; extra columns
are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import checkpointed, let_go, tidy

SHARD_ROWS = 8192
TREES, BITS = 128, 32
#: Queries answered exactly to measure the share of a shard to score, the part of their neighbours
#: that it has to hold, and the least number of candidates.
SAMPLE, SURE, PROBE_LEAST = 64, 0.9, 200
SEED = 5
#: Queries that descend together, and lists that are merged together.
TOGETHER, FAN = 256, 256


class Forest:
    """Sorted arrays of hash strings over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, lift: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees, self.bits, self.n = trees, bits, len(vectors)
        self.planes = rng.normal(size=(trees, vectors.shape[1] + 1, bits))
        self.powers = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        whole = np.hstack([vectors, lift[:, None]])
        self.order, self.sorted = np.empty((trees, self.n), np.int32), np.empty((trees, self.n), np.uint32 if bits <= 32 else np.uint64)
        for tree in range(trees):
            code = self._code(whole, tree)
            self.order[tree] = np.argsort(code, kind="stable")
            self.sorted[tree] = code[self.order[tree]]

    def _code(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        return ((vectors @ self.planes[tree]) > 0) @ self.powers

    def codes(self, queries: np.ndarray) -> np.ndarray:
        flat = np.hstack([queries, np.zeros((len(queries), 1))])
        return np.stack([self._code(flat, tree) for tree in range(self.trees)])

    def _bounds(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By tree and query: where the strings begin and end that share the first `level` bits."""
        drop = (self.bits - level).astype(np.uint64)
        low = (codes >> drop) << drop
        top = low + (np.uint64(1) << drop) - np.uint64(1)
        a, b = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for tree in range(self.trees):
            a[tree] = np.searchsorted(self.sorted[tree], low[tree].astype(self.sorted.dtype), "left")
            b[tree] = np.searchsorted(self.sorted[tree], top[tree].astype(self.sorted.dtype), "right")
        return a, b

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """Rows that meet each query on the way up, `least` of them or all there are."""
        for first in range(0, len(queries), TOGETHER):
            codes = self.codes(queries[first : first + TOGETHER])
            # The longest prefixes at which the trees hold enough, if no row were met twice: by halving.
            low, high = np.zeros(codes.shape[1], np.int64), np.full(codes.shape[1], self.bits)
            while (low < high).any():
                middle = (low + high + 1) // 2
                a, b = self._bounds(codes, middle)
                enough = (b - a).sum(axis=0) >= least
                low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
            level, found = low, [None] * len(low)
            todo = np.arange(len(low))
            while len(todo):
                a, b = self._bounds(codes[:, todo], level[todo])
                for i, q in enumerate(todo):
                    found[q] = self._met(a[:, i], b[:, i])
                todo = np.array([q for q in todo if level[q] > 0 and len(found[q]) < min(least, self.n)], np.int64)
                level[todo] -= 1
            yield from found

    def _met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = b - a
        at = np.arange(int(n.sum())) + np.repeat(a + np.arange(self.trees) * self.n - (np.cumsum(n) - n), n)
        seen = np.zeros(self.n, bool)
        seen[self.order.ravel()[at]] = True
        return np.flatnonzero(seen)

    def met_before(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each of these rows, how many rows the query has met when it meets this one."""
        code = self.codes(query[None])[:, 0]
        longest = np.zeros(self.n, np.int64)  # over the trees
        for tree in range(self.trees):
            apart = self.sorted[tree].astype(np.uint64) ^ code[tree]
            shared = self.bits - np.where(apart > 0, np.floor(np.log2(np.maximum(apart, 1).astype(np.float64))) + 1, 0).astype(np.int64)
            longest[self.order[tree]] = np.maximum(longest[self.order[tree]], shared)
        by_level = np.cumsum(np.bincount(longest, minlength=self.bits + 1)[::-1])[::-1]
        return by_level[longest[rows]]


def _valid(ids, vectors, width: int | None = None) -> tuple[list, list]:
    keep_ids, keep = [], []
    for i, v in zip(ids, vectors):
        if v is None or i is None or i != i:
            continue
        v = np.array([np.nan if x is None else x for x in v] if getattr(v, "dtype", None) == object else v, np.float64)
        if v.ndim == 1 and len(v) and (width is None or len(v) == width) and np.isfinite(v).all() and v.any():
            keep_ids.append(int(i))
            keep.append(v + 0.0)  # no negative zeros: equal vectors have equal bytes
    return keep_ids, keep


def _key(v: bytes) -> bytes:
    return hashlib.blake2b(v, digest_size=16).digest()


def _merged(k: int):
    """Rows -> one row for each distinct vector of the task, with its smallest ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, set[int]] = {}

        def rows() -> pd.DataFrame:
            data = [(_key(v), v, float(np.square(np.frombuffer(v)).sum()), sorted(ids)[: k + 1]) for v, ids in held.items()]
            held.clear()
            return pd.DataFrame(data, columns=["key", "vector", "square", "ids"])

        for batch in batches:
            for i, v in zip(*_valid(batch["id"], batch["v"])):
                data = v.tobytes()
                own = held.setdefault(data, set())
                own.add(i)
                if len(own) > 64 * (k + 1):
                    held[data] = set(sorted(own)[: k + 1])
            if len(held) > 50_000:
                yield rows()
        yield rows()

    return run


def distinct_vectors(rows: DataFrame, ident: str, column: str, k: int) -> DataFrame:
    """key, vector (float64 bytes), square (of its length), ids (the k + 1 smallest of those with this vector)."""
    each = rows.select(F.col(ident).cast("long").alias("id"), F.col(column).alias("v")).mapInPandas(tidy(_merged(k)), "key binary, vector binary, square double, ids array<long>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return each.groupBy("key").agg(F.min("vector").alias("vector"), F.min("square").alias("square"), smallest.alias("ids"))


def _forest_of(held: list[pd.DataFrame], longest: float, trees: int, bits: int) -> tuple[np.ndarray, list, np.ndarray, Forest]:
    vectors = np.frombuffer(b"".join(v for part in held for v in part["vector"])).reshape(sum(map(len, held)), -1)
    ids = [x for part in held for x in part["ids"]]
    first = np.array([x[0] for x in ids])
    lift = np.sqrt(np.maximum(0.0, longest - np.square(vectors).sum(axis=1)))
    return vectors, ids, first, Forest(vectors, lift, trees, bits)


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of a partition sorted by shard, cut where the shard changes."""
    for batch in batches:
        for shard, part in batch.groupby("shard", sort=True):
            yield shard, part


def _nearest(scores: np.ndarray, found: np.ndarray, first: np.ndarray, ids: list, most: int) -> tuple[list[int], list[float]]:
    """The first `most` distinct ids by falling score, then id."""
    if len(found) > 4 * most:
        some = np.argpartition(-scores, most)  # ties with the last of them stay
        found, scores = found[scores >= scores[some[most]]], scores[scores >= scores[some[most]]]
    best = np.lexsort((first[found], -scores))
    got: dict[int, float] = {}
    i = 0
    # Entries of equal score stand together, so that their ids can be put in order.
    while i < len(best) and len(got) < most:
        j = i
        while j < len(best) and scores[best[j]] == scores[best[i]]:
            j += 1
        for x in sorted(int(x) for b in best[i:j] for x in ids[found[b]]):
            got.setdefault(x, float(scores[best[i]]))
        i = j
    return list(got)[:most], list(got.values())[:most]


def _share(index: DataFrame, sample: list[bytes], longest: float, k: int, trees: int, bits: int, sure: float) -> float:
    """The share of a shard that has to be met for `sure` of the sample's nearest to be met."""
    queries = np.frombuffer(b"".join(sample)).reshape(len(sample), -1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answers(held: list[pd.DataFrame]) -> pd.DataFrame:
            vectors, _, _, forest = _forest_of(held, longest, trees, bits)
            out = []
            for q, query in enumerate(queries):
                scores = vectors @ query
                best = np.argsort(-scores)[: k + 1]
                best = best[(vectors[best] != query).any(axis=1)]
                out += zip([q] * len(best), (-scores[best]).tolist(), (forest.met_before(query, best) / len(vectors)).tolist())
            return pd.DataFrame(out, columns=["q", "far", "share"])

        open_shard, held = None, []
        for shard, part in _shards(batches):
            if shard != open_shard and held:
                yield answers(held)
                held = []
            open_shard = shard
            held.append(part)
        if held:
            yield answers(held)

    met = index.mapInPandas(tidy(measure), "q int, far double, share double")
    nearest = met.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "share"))), 1, k).alias("best"))
    got = nearest.select(F.explode("best").alias("b")).agg(F.percentile("b.share", sure)).first()[0]
    return float(got) if got is not None else 1.0


def nearest(rows: DataFrame, ident: str, column: str, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, sure: float = SURE, least: int = PROBE_LEAST, trees: int = TREES, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query holds for."""
    spark = rows.sparkSession
    entries = checkpointed(distinct_vectors(rows, ident, column, k))
    summary = entries.groupBy(F.length("vector").alias("w")).agg(F.count("*").alias("n"), F.max("square").alias("longest")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not summary:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide, count, longest = summary[0]
    entries = entries.filter(F.length("vector") == wide)
    shards = max(1, -(-count // shard_rows))

    asked = rows.filter(is_query).select(F.col(ident).cast("long").alias("id"), F.col(column).alias("v"))

    def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, vectors = _valid(batch["id"], batch["v"], wide // 8)
            data = [v.tobytes() for v in vectors]
            yield pd.DataFrame({"query_id": ids, "key": [_key(v) for v in data], "vector": data})

    asked = asked.mapInPandas(valid, "query_id long, key binary, vector binary")
    asked = checkpointed(asked.groupBy("query_id").agg(F.min(F.struct("key", "vector")).alias("a")).select("query_id", "a.key", "a.vector"))
    queries = asked.select("key", "vector").dropDuplicates(["key"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    index = entries.select(shard.alias("shard"), F.lit(False).alias("asks"), "key", "vector", "ids")
    some = [bytes(r.vector) for r in queries.orderBy("key").limit(sample).collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = _share(index.repartition(shards, "shard").sortWithinPartitions("shard"), some, longest, k, trees, bits, sure) if count > 2 * least else 1.0

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shard, held, made = None, [], None
        for number, part in _shards(batches):
            if number != open_shard:
                open_shard, held, made = number, [], None
            asks = part["asks"].to_numpy(bool)
            if not asks.all():
                held.append(part[~asks])
            if not asks.any() or not held:
                continue
            if made is None:
                made = _forest_of(held, longest, trees, bits)
            vectors, ids, first, forest = made
            enough = max(least, int(np.ceil(share * len(vectors))))
            out, asking = [], part[asks]
            matrix = np.frombuffer(b"".join(asking["vector"])).reshape(len(asking), -1)
            for key, q, found in zip(asking["key"], matrix, forest.candidates(matrix, enough)):
                out.append((key, *_nearest((vectors[found] * q).sum(axis=1), found, first, ids, k + 1)))
            yield pd.DataFrame({"shard": number, **dict(zip(("key", "ids", "scores"), map(list, zip(*out))))})
        let_go()

    # A shard's vectors come before the queries that visit it.
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "key", "vector", F.array().cast("array<long>").alias("ids"))
    visits = index.unionAll(asking).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = visits.mapInPandas(search, "shard int, key binary, ids array<long>, scores array<double>")
    pair = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("id")))
    lists = found.select("shard", "key", pair.alias("best"))
    # A list from each shard, merged by query, FAN of them at a time, and cut; of an id's several places the best stays.
    while shards > 1:
        shards = -(-shards // FAN)
        merged = lists.groupBy("key", F.expr(f"shard div {FAN}").cast("int").alias("shard")).agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("best"))
        once = F.filter("best", lambda x, i: F.array_position(F.col("best.id"), x["id"]) == i + 1)
        lists = merged.select("key", "shard", F.slice(once, 1, k + 1).alias("best"))
    rowed = asked.select("query_id", "key").join(lists, "key").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    out = rowed.select("query_id", F.posexplode("best").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
