"""Quality rules by suffix array: maximal repeated word runs, their union, and limits on both.

For each text a suffix array over its words is built by prefix doubling, many texts at a time in
one set of numpy sorts (the first key is the text, so suffixes of different texts never meet).
Each doubling round only sorts suffixes that still tie. The rank arrays of the rounds then give
the longest common prefix of neighbours by binary lifting. A longest-common-prefix interval of
height h is a maximal run of h words found more than once; the union of the spans of all runs of
at least m words is what positions with a neighbour prefix of m or more cover.

Defined results: null and blank texts have no words and fail the base rules (under 10 words);
repeated rows are judged alike; texts of any length are read whole; an empty table gives no rows;
extra columns pass through, but for those of the result's names, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import small_batches, words_of

#: Rules of the base check.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 10, 5, 20, "#*$%&|<>"
#: Limits of the method: runs of RUN words count; no more than this share of the words may lie in
#: them, and none may be longer than LONGEST words or, in longer texts, than this share of them.
RUN, MAX_COVERED, LONGEST, LONGEST_SHARE = 10, 0.15, 60, 0.1

CHUNK_WORDS = 250_000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def neighbour_prefix(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """By position: the longest run of words that starts there and elsewhere in the same text too.

    words holds the word numbers of all texts, bounds where each text begins and the last ends.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    tied = order[~(first & np.concatenate([first[1:], [True]]))]
    while len(tied):
        far = tied + step
        second = np.where(far < end[tied], rank[np.minimum(far, n - 1)], -1)
        by = np.lexsort((second, rank[tied]))
        tied, r1, r2 = tied[by], rank[tied][by], second[by]
        at = np.arange(len(tied))
        new1 = np.concatenate([[True], np.diff(r1) != 0])
        new2 = new1 | np.concatenate([[True], np.diff(r2) != 0])
        rank[tied] = r1 + np.maximum.accumulate(np.where(new2, at, 0)) - np.maximum.accumulate(np.where(new1, at, 0))
        levels.append(rank.astype(np.int32))
        tied = tied[~(new2 & np.concatenate([new2[1:], [True]]))]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    at = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[at], b[at]
    common = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[at + 1] = common
    out = np.empty(n, np.int64)
    out[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(prefix: np.ndarray, least: int) -> np.ndarray:
    """By position: whether a repeated run of at least so many words goes over it."""
    n = len(prefix)
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(prefix >= least)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + prefix[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def spans(text: str | None, least: int = RUN) -> list[tuple[int, int]]:
    """Merged spans, in words, of the maximal repeated runs of at least so many words."""
    words = words_of(text)
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    inside = np.concatenate([[0], covered(neighbour_prefix(numbers, np.array([0, len(words)])), least).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def line_stats(text: str | None) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text."""
    if not text:
        return 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    worded = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return chars, sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded))


def measure(texts: list[str | None], run: int = RUN) -> pd.DataFrame:
    """The columns of STATS for these texts, worked on together."""
    ids: dict[bytes, int] = {}
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for words in split for w in words), np.int64, int(bounds[-1]))
    prefix = neighbour_prefix(numbers, bounds)
    chars, symbols, lines = np.array([line_stats(t) for t in texts], np.int64).reshape(-1, 3).T

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[bounds[1:]] - total[bounds[:-1]]

    longest = np.zeros(len(texts), np.int64)
    some = lengths > 0
    if some.any():
        longest[some] = np.maximum.reduceat(prefix, bounds[:-1][some])
    return pd.DataFrame({"n_words": lengths, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": per_text(covered(prefix, WINDOW)), "covered_words": per_text(covered(prefix, run)), "longest_repeat": longest})


def chunks(texts: list[str | None], most: int = CHUNK_WORDS) -> Iterator[list[str | None]]:
    """Runs of texts of about so many words together; a longer text is a run by itself."""
    held, size = [], 0
    for t in texts:
        n = len(t) // 4 if t else 0
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def judged(docs: DataFrame, run: int = RUN, max_covered: float = MAX_COVERED, longest: int = LONGEST, longest_share: float = LONGEST_SHARE) -> DataFrame:
    """docs plus base statistics, base_failed, kept, covered_words and longest_repeat. Narrow: no shuffle."""

    small_batches(docs.sparkSession)
    @F.pandas_udf(STATS)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [measure(c, run) for c in chunks(texts.tolist())]
            yield pd.concat(parts, ignore_index=True) if parts else measure([], run)

    n = F.col("_stats.n_words")
    base_failed = (n < MIN_WORDS) | (100 * F.col("_stats.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    failed = (F.col("_stats.covered_words") > max_covered * n) | (F.col("_stats.longest_repeat") > F.greatest(F.lit(float(longest)), longest_share * n))
    *names, covered, repeat = [x.split()[0] for x in STATS.split(", ")]
    verdict = [base_failed.alias("base_failed"), (~base_failed & ~failed).alias("kept")]
    mine = [*[F.col(f"_stats.{x}").alias(x) for x in names], *verdict, *[F.col(f"_stats.{x}").alias(x) for x in (covered, repeat)]]
    others = [c for c in docs.columns if c not in (*names, covered, repeat, "base_failed", "kept")]
    return docs.withColumn("_stats", stats(F.col("text"))).select(*others, *mine)
