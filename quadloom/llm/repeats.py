"""Removal of long repeated byte strings, found by run-length indexes over the repetitive parts of a corpus.

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a smaller doc_id, or
before in the same document. The work is dealt out so that no index ever holds the corpus:

1. A window's minimizer is the K-byte string in it of the smallest hash (the first of equals).
   Neighbouring windows share it, so a document falls into pieces: runs of windows of one
   minimizer. Equal windows lie in pieces of equal minimizers, at the same place from it.
2. The pieces' hashes are dealt out and sorted by (minimizer, piece, document, place) over all documents. A piece
   that came before goes whole. A minimizer with a single distinct piece is done. Range partitions
   in that order split the pieces of any hot minimizer; what lies at their edges is settled by
   aggregates.
3. First occurrences of the pieces of all other minimizers go, with their bytes, to shards by
   minimizer. A shard leaves out what shares no stretch as long as its windows have in common,
   numbers each minimizer's pieces in order of place, and, bit by bit of these numbers, builds a
   run-length index of the pieces whose bit is 0 and streams those whose bit is 1 through it
   (run_index): every piece meets exactly those before it. Matches of WINDOW bytes are marked.
   A minimizer of more than MOST pieces (a line in countless contexts) goes to shards window by
   window instead, by the window's hash, the earliest of a task standing for its equals.
4. Marks meet their documents again, and the spans are cut.

Defined results: null and empty texts have no bytes; texts under WINDOW bytes keep all; rows equal
in doc_id and text are one document, each with its result; rows that share a doc_id but not the
text come in an order of their hash; rows without a doc_id come after all others, in that order
too; texts of any length are read whole; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import shared_folder, shuffle_partitions, small_batches, tidy
from quadloom.llm.run_index import RunIndex, Strings

WINDOW = 100
#: Bytes of a minimizer, and how many places a window has for it.
K = 16
PLACES = WINDOW - K + 1
#: Bytes of text whose pieces are cut at once: what fits a core's cache.
AT_ONCE = 1 << 17
#: Pieces of one sorted partition, bytes of one shard, pieces of a minimizer before it is split by windows.
ROWS, SHARD_BYTES, MOST = 400_000, 3 << 20, 20_000
#: Windows of a piece are told apart by so many ranges of places.
RANGES = 8
_LAST_ID = 2**63 - 1
_MINIMIZER = np.uint64(2**48 - 1)
_KEYS = ["m", "g", "doc", "tie", "at"]
_PIECES = "m long, g long, doc long, tie long, at int, span int"


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _mixed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hashes of K bytes by their first and last eight."""
    hashed = head * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= tail * np.uint64(0xC2B2AE3D27D4EB4F)
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return hashed


def pieces(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer and its place in the first window, of each piece of a text."""
    n = len(text)
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(text), 0, (1,))  # the eight bytes from each place on
    hashed = _mixed(words[: n - K + 1], words[K - 8 :])
    hashed &= np.uint64(0xFFFFFFFF00000000)
    hashed |= np.arange(len(hashed), dtype=np.uint64)
    span = 1
    while 2 * span <= PLACES:
        hashed = np.minimum(hashed[:-span], hashed[span:])
        span *= 2
    rest = PLACES - span
    least = np.minimum(hashed[:-rest], hashed[rest:]) if rest else hashed
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    best = least[at]
    spot = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = _mixed(words[spot], words[spot + K - 8])
    # The smallest hashes begin alike, so a minimizer is told by the lower bits of its hash.
    return at, np.diff(np.append(at, len(least))), (whole & _MINIMIZER).astype(np.int64), spot - at


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> pieces. Later equals of a piece in its own text have span -windows instead and a minimizer at random."""
    for batch in batches:
        held, size = [], 0
        for doc, tie, text in zip(batch["doc"].tolist(), batch["tie"].tolist(), batch["text"]):
            data = utf8(text)
            if len(data) >= WINDOW:
                held.append((doc, tie, data))
                size += len(data)
            if size >= AT_ONCE:
                yield _piece_rows(held)
                held, size = [], 0
        if held:
            yield _piece_rows(held)


def _piece_rows(held: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    """The texts are cut as one; windows that reach into the next text are dropped."""
    data = b"".join(x[2] for x in held)
    length = np.array([len(x[2]) for x in held], np.int64)
    start = np.cumsum(length) - length
    at, windows, m, place = pieces(np.frombuffer(data, np.uint8))
    owner = np.searchsorted(start, at, "right") - 1
    # A piece that runs on into the next text's windows is cut where that text begins.
    stop = at + windows
    over = stop > (start + length)[owner]
    more = owner[over] + 1
    at, m, place, stop, owner = (np.concatenate(x) for x in ((at, start[more]), (m, m[over]), (place, place[over] + at[over] - start[more]), (stop, stop[over]), (owner, more)))
    stop = np.minimum(stop, (start + length)[owner] - WINDOW + 1)
    good = stop > at
    at, m, place, stop, owner = (x[good] for x in (at, m, place, stop, owner))
    windows = stop - at
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(data)
    g = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (stop + WINDOW - 1).tolist())), np.uint64, len(at)).view(np.int64)
    order = np.lexsort((at, g, owner))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    docs, ties = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
    m = np.where(again, at * 0x9E3779B97F4B & int(_MINIMIZER), m)
    return pd.DataFrame({"m": m, "g": np.where(again, 0, g), "doc": docs[owner], "tie": ties[owner], "at": (at - start[owner]).astype(np.int32), "span": np.where(again, -windows, windows * 128 + place).astype(np.int32)})


#: What is known of a sorted piece: it goes; it is to be indexed; its minimizer is hot; its partition's edge hides the rest.
GOES, INDEXED, HOT, EDGE = 0, 1, 2, 3


def _in_order(m: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Rows by m, then by the other keys; most rows are alone with their m, so only the rest is compared by all keys."""
    order = np.argsort(m)
    same = np.concatenate([[False], m[order][1:] == m[order][:-1], [False]]) if len(m) else np.zeros(1, bool)
    tied = same[:-1] | same[1:]
    some = order[tied]
    order[tied] = some[np.lexsort((*(x[some] for x in reversed(others)), m[some]))]
    return order


def _told(most: int):
    """Pieces of one range partition, whole -> those that go and those to be indexed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        own = rows["span"].to_numpy() < 0
        rest = rows[~own]
        rest = rest.iloc[_in_order(*(rest[c].to_numpy() for c in _KEYS))]
        kind = np.zeros(len(rest), np.int64)
        if len(rest):
            m, g, doc, tie, at = (rest[c].to_numpy() for c in _KEYS)
            new_m = np.concatenate([[True], m[1:] != m[:-1]])
            new = new_m | np.concatenate([[True], g[1:] != g[:-1]])
            first = np.flatnonzero(new)
            head = first[np.cumsum(new) - 1]
            is_first = (doc == doc[head]) & (tie == tie[head]) & (at == at[head])
            of = np.cumsum(new_m) - 1
            distinct = np.bincount(of, weights=new)[of]
            edge = (of == 0) | (of == of[-1])
            kind = np.where(~is_first, GOES, np.where(edge, EDGE, np.where(distinct > most, HOT, np.where(distinct > 1, INDEXED, -1))))
        gone = rows[own].assign(kind=GOES, span=-rows["span"][own] * 128)
        out = pd.concat([gone, rest.assign(kind=kind)[kind >= 0]])
        yield out.astype({"kind": "int32"})[["kind", *_PIECES.replace(" int", "").replace(" long", "").split(", ")]]

    return run


def _by_window(hot: list[tuple], shards: int) -> tuple[list[tuple], list[tuple]]:
    """Windows of hot minimizers, the earliest of equals only, and marks of the others."""
    seen: dict[bytes, tuple] = {}
    marks = []
    for doc, tie, at, data in sorted(hot, key=lambda x: x[:3]):
        for k in range(len(data) - WINDOW + 1):
            window = data[k : k + WINDOW]
            if window in seen:
                marks.append((doc, tie, at + k, 1))
            else:
                seen[window] = (doc, tie, at + k)
    return [(xxhash.xxh3_64_intdigest(w) % shards, xxhash.xxh3_64_intdigest(w) >> 16, *x, 128, w) for w, x in seen.items()], marks


def _with_bytes(shards: int):
    """Documents with their pieces to be indexed -> the pieces' bytes, by shard; shard -1 holds marks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, hot, size = [], [], 0
            for doc, tie, text, found in zip(batch["doc"].tolist(), batch["tie"].tolist(), batch["text"], batch["found"]):
                data = utf8(text)
                for x in found:
                    m, at, span = x["m"], x["at"], x["span"]
                    held = data[at : at + (span >> 7) + WINDOW - 1]
                    size += len(held)
                    if x["kind"] == HOT:
                        hot.append((doc, tie, at, held))
                    else:
                        out.append((xxhash.xxh32_intdigest(m.to_bytes(8, "little")) % shards, m, doc, tie, at, span, held))
                if size > 4 << 20:
                    yield _byte_rows(out, hot, shards)
                    out, hot, size = [], [], 0
            yield _byte_rows(out, hot, shards)

    return run


_SHARDED = "shard long, m long, doc long, tie long, at int, span int, data binary"


def _byte_rows(out: list[tuple], hot: list[tuple], shards: int) -> pd.DataFrame:
    if hot:
        windows, marks = _by_window(hot, shards)
        out = out + windows + [(-1, 0, doc, tie, at, n * 128, None) for doc, tie, at, n in marks]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _SHARDED.split(", ")])


def _shared(m: list[int], data: list[bytes], place: list[int]) -> list[tuple[int, int]]:
    """Of each piece, the windows (first, last) that may be found in another piece of its minimizer; (0, -1) if none.

    Windows are told apart by where the minimizer lies in them. Those of one range of places have a
    stretch of bytes in common, so a window in two pieces means that both hold its range's stretch.
    """
    width = -(-PLACES // RANGES)
    digest = xxhash.xxh3_128_intdigest
    seen: set[tuple[int, int, int]] = set()
    twice: set[tuple[int, int, int]] = set()
    keyed: list[list[tuple[int, int, int]]] = []
    for minimizer, piece, at in zip(m, data, place):
        windows, mine = len(piece) - WINDOW + 1, []
        for r in range(max(0, at - windows + 1) // width, at // width + 1):  # the ranges that windows of the piece lie in
            key = (minimizer, r, digest(piece[at - r * width : at - min(r * width + width, PLACES) + 1 + WINDOW]))
            mine.append(key)
            if key in seen:
                twice.add(key)
            else:
                seen.add(key)
        keyed.append(mine)
    out = []
    for mine, piece, at in zip(keyed, data, place):
        kept = [key[1] for key in mine if key in twice]
        if kept:  # a window of range r begins r * width to r * width + width - 1 bytes before the minimizer
            out.append((max(0, at - kept[-1] * width - width + 1), min(len(piece) - WINDOW, at - kept[0] * width)))
        else:
            out.append((0, -1))
    return out


def earlier(m: np.ndarray, data: list[bytes], place: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window): windows that a piece before it of the same minimizer holds. Pieces come in order by minimizer."""
    spans = _shared(m.tolist(), data, place)
    kept = np.array([k for k, (a, b) in enumerate(spans) if b >= a], np.int64)
    none = np.zeros(0, np.int64)
    if len(kept) < 2:
        return none, none
    begin = np.array([spans[k][0] for k in kept], np.int64)
    strings = Strings([data[k][spans[k][0] : spans[k][1] + WINDOW] for k in kept.tolist()])
    mine = m[kept]
    new = np.concatenate([[True], mine[1:] != mine[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(mine)))
    number, total = np.arange(len(mine)) - np.repeat(first, size), np.repeat(size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bit = 0
    while (1 << bit) < total.max():
        half, block = (number >> bit) & 1, number >> (bit + 1)
        indexed = (half == 0) & ((block << (bit + 1)) + (1 << bit) < total)
        which, offset = RunIndex(strings, indexed, block).long_matches(np.flatnonzero(half == 1), block, WINDOW)
        found.append((kept[which], offset + begin[which]))
        bit += 1
    which, window = (np.concatenate(x) for x in zip(*found))
    both = np.unique(which << 32 | window)
    return both >> 32, both & 0xFFFFFFFF


_MARKS = "doc long, tie long, at int, windows int"


def _marked(shard: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one shard -> runs of windows that start earlier."""
    rows = shard.drop_duplicates(["m", "doc", "tie", "at"]).sort_values(["m", "doc", "tie", "at"], ignore_index=True)
    which, window = earlier(rows["m"].to_numpy(np.int64), list(rows["data"]), (rows["span"] & 127).tolist())
    if not len(which):
        return pd.DataFrame({"doc": [], "tie": [], "at": [], "windows": []}).astype({"doc": "int64", "tie": "int64", "at": "int32", "windows": "int32"})
    first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)]))
    size = np.diff(np.append(first, len(which)))
    at = rows["at"].to_numpy()[which[first]] + window[first]
    return pd.DataFrame({"doc": rows["doc"].to_numpy()[which[first]], "tie": rows["tie"].to_numpy()[which[first]], "at": at.astype(np.int32), "windows": size.astype(np.int32)})


def spans_of(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, stop) under the marked windows (first, how many)."""
    out: list[tuple[int, int]] = []
    for at, windows in sorted(marks):
        stop = at + windows + WINDOW - 1
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((at, stop))
    return out


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, tie, text, marks in zip(batch["doc"].tolist(), batch["tie"].tolist(), batch["text"], batch["marks"]):
            data = utf8(text)
            spans = spans_of([(x["at"], x["windows"]) for x in marks]) if marks is not None else []
            kept, last = hashlib.sha256(), 0
            for start, stop in spans:
                kept.update(data[last:start])
                last = stop
            kept.update(data[last:])
            rows.append((None if tie & 1 else doc, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), spans))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        yield out.astype({"doc_id": "Int64"})


def _keyed(docs: DataFrame, twice: bool) -> DataFrame:
    """doc, tie, text: tie is 0 for ids of one row, else from the text's hash; it is odd for rows without an id."""
    tie: Column = F.shiftleft(F.xxhash64("text"), 1)
    tie = F.when(F.col("doc_id").isNull(), tie.bitwiseOR(F.lit(1))).otherwise(tie if twice else F.lit(0).cast("long"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc"), tie.alias("tie"), F.col("text"))


def deduplicated(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    texts = _keyed(docs, twice)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    parts = max(shuffle_partitions(spark), 2 * size // (PLACES * ROWS) + 1)
    rows = texts.filter(F.octet_length("text") >= WINDOW).mapInPandas(tidy(_cut), _PIECES)
    told = rows.repartitionByRange(int(parts), *_KEYS).mapInPandas(tidy(_told(most)), f"kind int, {_PIECES}")
    told.write.parquet(f"{folder}/told")
    told = spark.read.parquet(f"{folder}/told")
    edges = _edges(told.filter(F.col("kind") == EDGE), most)
    told = told.filter(F.col("kind") != EDGE).unionByName(edges)
    wanted = told.filter(F.col("kind").isin(INDEXED, HOT))

    total = wanted.agg(F.sum(F.expr(f"shiftright(span, 7) + {WINDOW} - 1"))).first()[0] or 0
    shards = int(total // SHARD_BYTES) + 1
    n = shuffle_partitions(spark)
    dealt = texts.repartition(n, "doc", "tie")
    by_doc = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "m", "at", "span")).alias("found"))
    sharded = dealt.join(by_doc, ["doc", "tie"]).mapInPandas(tidy(_with_bytes(shards)), _SHARDED)
    marks = sharded.filter("shard >= 0").groupBy("shard").applyInPandas(_marked, _MARKS)
    hot = sharded.filter("shard < 0").selectExpr("doc", "tie", "at", "shiftright(span, 7) as windows")
    whole = told.filter(F.col("kind") == GOES).selectExpr("doc", "tie", "at", "shiftright(span, 7) as windows")
    all_marks = whole.unionByName(marks).unionByName(hot).groupBy("doc", "tie").agg(F.collect_list(F.struct("at", "windows")).alias("marks"))
    spans = "spans array<struct<start: int, stop: int>>"
    return dealt.join(all_marks, ["doc", "tie"], "left").mapInPandas(tidy(_cleaned), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {spans}")


def _edges(edges: DataFrame, most: int) -> DataFrame:
    """What partitions could not tell of their first and last minimizers, by aggregates over all partitions."""
    place = F.struct("doc", "tie", "at")
    firsts = edges.groupBy("m", "g").agg(F.min(place).alias("first"))
    sizes = firsts.groupBy("m").agg(F.count("*").alias("distinct"))
    known = edges.join(firsts, ["m", "g"]).join(sizes, "m")
    kind = F.when(place != F.col("first"), GOES).when(F.col("distinct") > most, HOT).when(F.col("distinct") > 1, INDEXED)
    return known.withColumn("kind", kind).filter("kind is not null").select("kind", *[c.split()[0] for c in _PIECES.split(", ")])
