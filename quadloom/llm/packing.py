"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece
lengths). Pieces are placed longest first. Of the open bins in which all three of a piece's sizes
still fit, the one that scores best takes it: by weighted dot product of sizes and residuals (both
as shares of capacity, the smallest residue wins) or by the norm of what would be left. Bins are
kept as one row for each distinct residual vector, so the choice is one numpy pass over distinct
residuals, not over bins.

Work is split by a hash of row numbers into shards of about SHARD_PIECES pieces. Each is packed
by itself; a shard leaves at most a few bins part full, so the loss is a few sequences in
thousands, whatever the size of the corpus, and no document, source or group of copies can make a
shard larger than others.

Defined results: a null or empty text is the one token that ends a document; longer documents are
cut into pieces of the capacity, the last one shorter; repeated rows are packed as rows of their
own; extra columns are left out; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import checkpointed, small_batches, tidy

TOKENS = 2048
#: Beyond these no sequence of TOKENS tokens can go, so they bind only where a caller lowers them.
DOCUMENTS, ATTENTION = TOKENS, TOKENS * TOKENS
WEIGHTS = (1.0, 0.1, 0.1)
SHARD_PIECES = 8192
CACHE_CHUNKS = 700_000
#: Characters of texts whose chunks are numbered together (a longer text is numbered by itself).
SOME_CHARS = 1 << 20
#: Chunks in one call of the tokenizer: what it returns of each is a hundred times the ids that are kept.
SOME_CHUNKS = 1000
END = np.uint32(0).tobytes()

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core of its own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Lower-case Latin letters that have one form only.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class ChunkIds:
    """Token ids of texts, as little-endian bytes, through a bounded cache of chunks between spaces.

    The tokenizer lower-cases, splits at white space before all else, drops it, and splits between
    a letter and a point or comma; so the ids of a text are those of its chunks one after another,
    with A-Z lower-cased and such points and commas as chunks of their own. Only chunks not met
    lately go to the tokenizer. Texts that hold one of its special tokens are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = tokenizer(path)
        self.encode = whole.encode_batch_fast
        # For words that its normaliser and pattern leave as they are: the same model without them.
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.encode_plain = bare.encode_batch_fast
        special = [re.escape(t.content) for t in whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special), re.I) if special else None
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Splitting and numbering of chunks run in Arrow, so Python meets each distinct chunk of a batch once."""
        odd = {i for i, t in enumerate(texts) if t and self.special and self.special.search(t)}
        held = pa.array([t if t and i not in odd else "" for i, t in enumerate(texts)], pa.large_string())
        held = pc.replace_substring_regex(pc.ascii_lower(held), r"([a-z])([.,])([ \n]|$)", r"\1 \2\3")
        lists = pc.split_pattern(pc.replace_substring(held, "\n", " "), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = lists.flatten().dictionary_encode()
        # By way of numpy, which makes the strings many times faster than to_pylist().
        chunks, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        data = list(map(known.get, chunks))
        new = [i for i, d in enumerate(data) if d is None]
        if new:
            plain, other = [], []
            for i in new:
                (plain if _PLAIN(chunks[i]) else other).append(chunks[i])
            self._learn(plain, self.encode_plain)
            self._learn(other, self.encode)
            for i in new:
                data[i] = known[chunks[i]]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids, begin = np.frombuffer(b"".join(data), "<u4"), np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        flat = ids[np.arange(int(n.sum())) + np.repeat(begin[code] - (ends - n), n)].tobytes()
        edge = np.concatenate([[0], ends])[lists.offsets.to_numpy()] * 4
        out = [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        for i in odd:
            out[i] = _packed_ids(self.encode([texts[i]], add_special_tokens=False))[0]
        return out

    def _learn(self, chunks: list[str], encode: Callable) -> None:
        for a in range(0, len(chunks), SOME_CHUNKS):
            some = chunks[a : a + SOME_CHUNKS]
            self.known.update(zip(some, _packed_ids(encode(some, add_special_tokens=False))))


def _packed_ids(encodings: list) -> list[bytes]:
    return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in encodings)]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in their order, as many together as SOME_CHARS hold, one at least."""
    group, chars = [], 0
    for text in texts:
        n = len(text) if text else 0
        if group and chars + n > SOME_CHARS:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += n
    if group:
        yield group


def pieces(docs: DataFrame, path: str, tokens: int = TOKENS) -> DataFrame:
    """The pieces of all documents with the checksums of their ids. Narrow: no shuffle."""

    small_batches(docs.sparkSession)
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = ChunkIds(path)
        for batch in batches:
            rows = []
            texts = batch["text"].tolist()
            found = (ids for some in _groups(texts) for ids in ids_of(some))
            for doc, data in zip(batch["doc_id"].tolist(), found):
                data += END
                for k, at in enumerate(range(0, len(data), 4 * tokens)):
                    part = data[at : at + 4 * tokens]
                    rows.append((doc, k, k * tokens, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(cut), PIECES)


def best_fit(lengths: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights=WEIGHTS, by: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece that no empty bin could hold is an error."""
    capacity = np.array([tokens, documents, attention], np.float64)
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention or documents < 1):
        raise ValueError("a piece is larger than an empty sequence")
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    weight = np.array(weights)
    residual = np.empty((64, 3), np.int64)  # distinct residual vectors
    share = np.empty((64, 3))
    rows: dict[tuple[int, int, int], int] = {}
    open_bins: dict[int, list[int]] = defaultdict(list)
    used = 0

    def put(b: int, left: tuple[int, int, int]) -> None:
        nonlocal used, residual, share
        if left[0] < 1 or left[1] < 1 or left[2] < 1:
            return
        if left not in rows:
            if used == len(residual):
                residual, share = np.concatenate([residual, residual]), np.concatenate([share, share])
            residual[used], share[used] = left, np.array(left) / capacity
            rows[left] = used
            used += 1
        open_bins[rows[left]].append(b)

    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        need = np.array([n, 1, n * n])
        at = -1
        if used:
            fits = np.flatnonzero((residual[:used] >= need).all(axis=1))
            if len(fits):
                if by == "dot":
                    score = (share[fits] * (weight * need / capacity)).sum(axis=1)
                else:
                    score = (weight * (share[fits] - need / capacity) ** 2).sum(axis=1)
                at = int(fits[score.argmin()])
        if at < 0:
            b, left = opened, (tokens, documents, attention)
            opened += 1
        else:
            left = tuple(int(x) for x in residual[at])
            b = open_bins[at].pop()
            if not open_bins[at]:  # the last row moves into the gap
                del rows[left], open_bins[at]
                used -= 1
                if at != used:
                    moved = tuple(int(x) for x in residual[used])
                    residual[at], share[at] = residual[used], share[used]
                    rows[moved], open_bins[at] = at, open_bins.pop(used)
        bins[i], offsets[i] = b, tokens - left[0]
        put(b, (left[0] - n, left[1] - 1, left[2] - n * n))
    return bins, offsets


def packed(docs: DataFrame, path: str, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights=WEIGHTS, by: str = "dot", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its sequence_id and offset in it."""
    cut = checkpointed(pieces(docs, path, tokens))
    return _packed(cut, cut.count(), tokens, documents, attention, weights, by, shard_pieces)


def _packed(cut: DataFrame, count: int, tokens: int, documents: int, attention: int, weights, by: str, shard_pieces: int) -> DataFrame:
    shards = max(1, -(-count // shard_pieces))
    # Row numbers of a checkpoint stay what they are; copies of one row go to different shards.
    thin = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(shard["length"].to_numpy(), tokens, documents, attention, weights, by)
        return shard.assign(sequence_id=shard["shard"] * 10**9 + bins, offset=offsets).drop(columns="shard")

    return thin.groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
