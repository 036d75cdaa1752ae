"""Exact n-gram Jaccard join by partitioning the universe of shingles.

Two sets whose Jaccard similarity reaches num/den differ in at most H tokens, H following from
their sizes. Tokens are hashed into segments, their number set by the band of sizes a pair lies in.
Differing tokens can spoil so many segments at most, so if the segments' allocations add up to more
than H, some segment must agree: exactly where its allocation is 1, up to one token where it is 2
(both sides then also index the segment with each token deleted). Which segments get 2 is chosen by
cost, by band: longer segments with deletion neighbourhoods are more selective, exact ones cheaper.

The allocations add up to more than H + 1 by a slack. Segments that tell little (those of a token
or none, and those that more than COMMON sets share, such as parts of a passage quoted everywhere) may
be left out as long as the slack covers them; a set with more of them keeps them all. So no pair is
lost.

Sets that meet in a segment are only candidates. Rather than list pairs, the join takes connected
components of "meets the smallest set of the segment". One of more than BLOCK_TOKENS tokens is
refined: its sets meet again in their prefixes (the tokens rarest within it, as many as two linked
sets can't both lack), which parts sets that only quote the same passages. Components are then split
into blocks of a bounded number of tokens and block is compared with block inside one task: by prefixes in order of frequency, sizes,
and exact overlaps, leaving out pairs already known to be connected. Each task returns a spanning
forest of verified links, so rows out never exceed documents times blocks. Equal sets are one
class from the start.

Tokens are 64-bit hashes of shingles; sets count as equal if their sizes and two 64-bit sums agree.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a text
with fewer than n words has its whole sequence as its one shingle; rows that share a doc_id are one
document; a null doc_id is left alone (a component of its own, null); extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import checkpointed, lower_words_of, mix64, small_batches, tidy
from quadloom.llm.components import components

COMMON = 24
BAND_RATIO = 1.3
#: For the cost of an allocation: how likely a token is one that other sets hold too.
SHARED = 0.05
#: Tokens of one block of a component; a task compares two blocks.
BLOCK_TOKENS = 400_000
#: A thin table of ids (with component and blocks, 20 bytes a row) is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
CACHE_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their n-word shingles."""

    def __init__(self, n: int):
        self.n, self.cache = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = lower_words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        try:
            hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(cache):
                cache[w] = xxhash.xxh64_intdigest(w)
            hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total = total * _ODD + hashes[k : len(words) - n + 1 + k]
        return np.unique(mix64(total))


@dataclass(frozen=True)
class Threshold:
    num: int
    den: int

    def linked(self, common, union):
        return self.den * common >= self.num * union

    def most_apart(self, size: int) -> int:
        """Tokens in which two linked sets of up to this size can differ."""
        return self.most_apart_of(size, size)

    def most_apart_of(self, size: int, other: int) -> int:
        return (size + other) * (self.den - self.num) // (self.den + self.num)

    def most_size(self, size: int) -> int:
        """The largest set that can link with one of this size."""
        return self.den * size // self.num

    def least_size(self, size: int) -> int:
        """The smallest set that can link with one of this size."""
        return -(-self.num * size // self.den)


@cache
def band_top(band: int) -> int:
    """Largest size in a band."""
    return 4 if band < 0 else max(band_top(band - 1) + 1, int(band_top(band - 1) * BAND_RATIO))


@cache
def band_of(size: int) -> int:
    band = 0
    while band_top(band) < size:
        band += 1
    return band


@cache
def allocation(band: int, t: Threshold, sets: int) -> tuple[int, int]:
    """Exact segments and segments with deletions, for pairs whose larger set lies in this band."""
    size = band_top(band)
    apart = t.most_apart(size)
    need = apart + 3 + apart // 10
    best = None
    for two in range(need // 2 + 1):
        one = need - 2 * two
        mean = size / (one + two)
        rows = one + two * (1 + mean)
        met = sets * (one * SHARED**mean + two * (SHARED**mean + 2 * mean * SHARED ** max(0.0, mean - 1)))
        cost = rows + min(met, 1e9)
        if best is None or cost < best[0]:
            best = (cost, one, two)
    return best[1], best[2]


def signatures(tokens: np.ndarray, t: Threshold, sets: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each band that the set takes part in: signatures, their weights (1 or 2), and what is left of the slack.

    The slack is what the allocations exceed, by one, the tokens in which this set and one that it
    can link with may differ. Segments that tell little are left out if the slack covers them.
    Otherwise all are kept and the slack is -1: such a set keeps common segments too. So of two
    linked sets, whatever each leaves out, they agree in a segment that both keep.
    """
    size = len(tokens)
    own = band_of(size)
    out = []
    for band in (own, own + 1):
        if band > own and size < t.least_size(band_top(own) + 1):
            break
        if t.most_apart(band_top(band)) == 0:
            continue
        one, two = allocation(band, t, sets)
        m = one + two
        mixed = mix64(tokens + np.uint64((band + 1) * 0x51ED27 * int(_ODD) % 2**64))
        segment = ((mixed >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        mixed, segment = mixed[order], segment[order]
        held = np.bincount(segment, minlength=m)
        allocated = np.where(np.arange(m) < one, 1, 2)
        told = (held > (1 if m >= 12 else 0)) | (allocated == 2)  # one with deletions may meet a smaller one
        partner = min(band_top(band), t.most_size(size))
        slack = one + 2 * two - 1 - t.most_apart_of(size, partner) - int(allocated[~told].sum())
        if slack < 0:
            told[:], slack = True, -1
        first = np.cumsum(held) - held
        sums = np.zeros(m, np.uint64)
        some = held > 0
        sums[some] = np.add.reduceat(mixed, first[some])
        salt = mix64((np.arange(m).astype(np.uint64) + np.uint64(band << 32)) * _ODD + np.uint64(77))
        sigs, weights = [(sums + salt)[told]], [allocated[told]]
        late = (segment >= one) & told[segment]
        if late.any():
            sigs.append((sums[segment] - mixed + salt[segment])[late])
            weights.append(np.full(int(late.sum()), 2))
        out.append((mix64(np.concatenate(sigs)), np.concatenate(weights), slack))
    return out


def class_keys(tokens: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mix64(tokens)) + np.uint64(len(tokens))
    b = np.add.reduce(mix64(tokens ^ _ODD))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                tokens = shingle(text)
                rows.append((doc, len(tokens), *class_keys(tokens)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "k1", "k2"])

    return run


def _signature_rows(n: int, t: Threshold, sets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(n), set()
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for text in batch["text"]:
                tokens = shingle(text)
                if len(tokens) == 0:
                    continue
                key = class_keys(tokens)[0]
                if key in seen:  # a copy in the same task adds nothing
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                for k, (sigs, weights, slack) in enumerate(signatures(tokens, t, sets)):
                    parts.append((sigs.astype(np.int64), np.full(len(sigs), key), (min(slack, 1 << 20) * 8 + k * 4 + weights).astype(np.int32)))
                    held += len(sigs)
                if held > 200_000:
                    yield _signature_frame(parts)
                    parts, held = [], 0
            if parts:
                yield _signature_frame(parts)

    return run


def _signature_frame(parts: list[tuple]) -> pd.DataFrame:
    sigs, keys, meta = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"sig": sigs, "k1": keys, "meta": meta})


def _tokens(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            yield pd.DataFrame({"rep": batch["doc_id"], "component": batch["component"], "blocks": batch["blocks"], "tokens": [shingle(x).tobytes() for x in batch["text"]]})

    return run


def _prefix_tokens(n: int, t: Threshold):
    """Texts -> (rep, keep, token): each token with how many of its set's tokens make up the prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            held, size = [], 0
            for rep, text in zip(batch["doc_id"].tolist(), batch["text"]):
                held.append((rep, shingle(text)))
                size += len(held[-1][1])
                if size > 200_000:
                    yield _prefix_frame(held, t)
                    held, size = [], 0
            if held:
                yield _prefix_frame(held, t)

    return run


def _prefix_frame(held: list[tuple[int, np.ndarray]], t: Threshold) -> pd.DataFrame:
    sizes = np.array([len(tokens) for _, tokens in held], np.int64)
    keep = np.array([k - t.least_size(int(k)) + 1 for k in sizes], np.int64)
    reps = np.array([rep for rep, _ in held], np.int64)
    return pd.DataFrame({"rep": np.repeat(reps, sizes), "keep": np.repeat(keep, sizes), "token": np.concatenate([tokens for _, tokens in held]).astype(np.int64)})


def links_within(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; where both sides occur, only links between sides are looked for."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    ids, side, sizes, sets = ids[order], side[order], sizes[order], [sets[i] for i in order]
    cross = side.min() != side.max()
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_rarity = np.empty(len(count), np.int64)
    by_rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(count), bool)
    root = np.arange(len(sets))
    _, root = np.unique(ids, return_inverse=True)  # rows of one document are connected from the start
    postings: dict[int, list[int]] = defaultdict(list)
    found = []
    for x in range(len(sets)):
        own, size = token[edge[x] : edge[x + 1]], int(sizes[x])
        prefix = own[np.argsort(by_rarity[own])][: size - t.least_size(size) + 1]
        prefix = prefix[count[prefix] > 1].tolist()
        met = [y for p in prefix for y in postings[p]]
        for p in prefix:
            postings[p].append(x)
        if not met:
            continue
        met = np.unique(np.array(met))
        met = met[(sizes[met] >= t.least_size(size)) & (root[met] != root[x])]
        if cross:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        mark[own] = True
        length = sizes[met]
        at = np.cumsum(length) - length
        flat = token[np.arange(int(length.sum())) + np.repeat(edge[met] - at, length)]
        common = np.add.reduceat(mark[flat].astype(np.int64), at)
        mark[own] = False
        for y in met[t.linked(common, size + length - common)]:
            if root[y] != root[x]:
                found.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]
    return found


def _compare(t: Threshold):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block["tokens"]]
        found = links_within(block["rep"].to_numpy(np.int64), sets, block["side"].to_numpy(), t)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def joined(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, component_id being the smallest doc_id reachable by links."""
    t = Threshold(num, den)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = checkpointed(texts.mapInPandas(tidy(_sets(n)), "doc_id long, n_shingles long, k1 long, k2 long"))
    count = sets.count()
    classes = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))

    links = _links(texts, classes, n, t, max(1, count)).unionAll(_same_document(classes, sets))
    found = components(links, contracted=True)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("_component"))
    out = sets.join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _same_document(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    both = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("k1"), F.max("k1").alias("top"), F.count("*").alias("rows")).filter("rows > 1 and k1 <> top").select("doc_id")
    mine = sets.join(both, "doc_id", "left_semi").join(classes, ["k1", "k2", "n_shingles"])
    return mine.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def candidates(texts: DataFrame, n: int, t: Threshold, count: int) -> DataFrame:
    """(node, component) of classes, by k1, that some allocated segment brings together."""
    rows = texts.select("text").mapInPandas(tidy(_signature_rows(n, t, count)), "sig long, k1 long, meta int")
    met = rows.selectExpr("*", "min(k1) over (partition by sig) as low", "max(k1) over (partition by sig) as high").filter("low < high")
    met = checkpointed(met.select("sig", "k1", "meta").distinct())
    # What a set loses by band if it leaves its common segments out; beyond its slack it needs them.
    lost = f"sum(if(met > {COMMON}, meta & 3, 0)) over (partition by k1, shiftright(meta, 2)) as lost"
    marked = met.selectExpr("*", "count(*) over (partition by sig) as met").selectExpr("*", lost)
    kept = marked.filter(f"met <= {COMMON} or lost > shiftright(meta, 3)")
    edges = kept.selectExpr("k1", "min(k1) over (partition by sig) as pivot").filter("k1 <> pivot").distinct()
    return components(edges, "k1", "pivot")


def _sized(members: DataFrame) -> DataFrame:
    """members plus the number of blocks of their component."""
    size = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_TOKENS).cast("int").alias("blocks"))
    return members.join(size, "component").select("rep", "component", "blocks", "n_shingles")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of wanted, rep as doc_id, with the texts of the documents that it names."""
    wanted = wanted.withColumnRenamed("rep", "doc_id")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return texts.filter("text is not null").join(wanted, "doc_id").select(*wanted.columns, "text")


def _prefix_edges(texts: DataFrame, wide: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(rep, pivot): sets that share a token of their prefixes, each with the smallest such set."""
    rows = _texts_of(texts, wide.select("rep")).mapInPandas(tidy(_prefix_tokens(n, t)), "rep long, keep long, token long").distinct()
    known = rows.groupBy("token").agg(F.count("*").alias("n"))
    ranked = rows.join(known, "token").selectExpr("*", "row_number() over (partition by rep order by n, token) as at")
    prefixes = checkpointed(ranked.filter("at <= keep and n > 1").select("rep", "token"))
    pivots = prefixes.groupBy("token").agg(F.min("rep").alias("pivot"))
    return prefixes.join(pivots, "token").select("rep", "pivot").filter("rep <> pivot").distinct()


def _links(texts: DataFrame, classes: DataFrame, n: int, t: Threshold, count: int) -> DataFrame:
    groups = candidates(texts, n, t, count)
    members = groups.withColumnRenamed("node", "k1").join(classes, "k1").select("rep", "component", "n_shingles")
    members = checkpointed(_sized(members))
    wide = members.filter("blocks > 1").select("rep", "component", "blocks")
    if not wide.isEmpty():
        refined = components(_prefix_edges(texts, wide, n, t), "rep", "pivot")
        again = refined.withColumnRenamed("node", "rep").join(members.select("rep", "n_shingles"), "rep").select("rep", F.xxhash64("component", F.lit(1)).alias("component"), "n_shingles")
        members = checkpointed(members.filter("blocks = 1").unionByName(_sized(again)))
    total = members.filter("blocks = 1").agg(F.sum("n_shingles")).first()[0]
    bins = max(1, -(-int(total or 0) // BLOCK_TOKENS)) * 2
    tokens = _texts_of(texts, members.select("rep", "component", "blocks")).mapInPandas(tidy(_tokens(n)), "rep long, component long, blocks int, tokens binary")
    placed = tokens.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    small = placed.filter("blocks = 1").select(F.pmod(F.hash("component"), F.lit(bins)).cast("long").alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "rep", F.lit(0).alias("side"), "tokens")
    large = placed.filter("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    large = large.select(F.col("component").alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", F.col("block").alias("side"), "tokens")
    return small.unionAll(large).groupBy("g", "i", "j").applyInPandas(_compare(t), "a long, b long")
