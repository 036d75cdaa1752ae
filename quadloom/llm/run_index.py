"""A run-compressed Burrows-Wheeler transform and matching statistics, for many strings at once, in numpy.

The strings are kept with a terminator each and their suffixes sorted once. An index over some of
them takes the rows of their suffixes out of that order and keeps one entry for each run of equal
preceding bytes: where the run starts, where its rows go when they are extended to the left, and the
text positions of its first and last row (the sampled run ends). Strings may carry a group number;
groups are indexed beside one another, so that a pattern only meets strings of its own group.

Patterns are read from right to left, all in step. Each keeps one row with its longest match and the
match's length. While the byte before that row is the pattern's next one, the row is mapped on.
Otherwise the nearest runs of the next byte above and below are tried: their sampled ends tell the
text positions, and the common extension with the present match tells which of them keeps more.
"""

from __future__ import annotations

import numpy as np

#: Ends each string; no byte of UTF-8.
END = 255
#: Patterns read in step.
IN_STEP = 1 << 15
_WORD = 8


class Strings:
    """Byte strings, none holding END, of at most `longest` bytes, with all their suffixes in order."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.longest = int(self.length.max(initial=0))
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        padded = np.concatenate([self.text, np.zeros(self.longest + 2 * _WORD, np.uint8)])
        # The eight bytes from each position on, first byte highest.
        self.words = np.ndarray((len(padded) - _WORD + 1,), ">u8", padded, 0, (1,)).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), self.length + 1)
        self.order = self._sorted()

    def _sorted(self) -> np.ndarray:
        """Positions by the text from there to the end of their string, ties by position: prefix doubling."""
        n = len(self.text)
        left = (self.start + self.length)[self.owner] - np.arange(n) + 1  # bytes up to the terminator, itself included
        keep = np.minimum(left, _WORD).astype(np.uint64)
        key = self.words[:n] & ~((np.uint64(1) << (np.uint64(8) * (np.uint64(_WORD) - keep) - np.uint64(keep.max() == 0))) - np.uint64(1))
        order = np.argsort(key)
        rank, tied = _ranks(key[order], np.arange(n))
        place = np.empty(n, np.int64)
        place[order] = rank
        rows = np.flatnonzero(tied)
        depth = _WORD
        while len(rows) and depth <= self.longest:
            at = order[rows]
            ahead = np.where(left[at] > depth, place[np.minimum(at + depth, n - 1)] + 1, 0)
            key = (place[at].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
            again = np.argsort(key)
            at, key = at[again], key[again]
            order[rows] = at
            rank, tied = _ranks(key, rows)
            place[at] = rank
            rows = rows[tied]
            depth *= 2
        if len(rows):  # equal up to their terminators
            at = order[rows]
            order[rows] = at[np.lexsort((at, place[at]))]
        return order


def _ranks(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the row of the first equal one, and whether others are equal."""
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    return np.repeat(rows[first], size), np.repeat(size > 1, size)


class RunIndex:
    """The transform of the member strings' suffixes by group, run by run."""

    def __init__(self, strings: Strings, member: np.ndarray, group: np.ndarray):
        self.strings = strings
        text, n = strings.text, len(strings.text)
        at = strings.order[member[strings.owner[strings.order]]]
        mine = group[strings.owner[at]]
        if len(mine) and mine.min() != mine.max():
            by_group = np.argsort(mine, kind="stable")
            at, mine = at[by_group], mine[by_group]
        row_of = np.zeros(n, np.int32)
        row_of[at] = np.arange(len(at), dtype=np.int32)
        key = mine.astype(np.int64) * 256 + text[at - 1]  # at 0 the last terminator stands before
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(at))[: len(starts)] - 1
        self.starts, self.lengths, self.key = starts, ends - starts, key[starts]
        self.to = row_of[at[starts] - 1].astype(np.int64)
        self.first, self.last = at[starts].astype(np.int64), at[ends].astype(np.int64)
        runs = len(starts)
        order = np.argsort(self.key, kind="stable")
        self.by_key, self.runs_by_key = self.key[order] * (runs + 1) + order, order
        tops = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
        self.top = np.full(int(group.max(initial=0)) + 1, -1, np.int64)
        self.top[mine[tops]] = tops

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the texts from a and from b on have in common, up to most."""
        words, found = self.strings.words, most.copy()
        left = np.arange(len(a))
        depth = 0
        while len(left):
            left = left[most[left] > depth]
            differ = words[a[left] + depth] ^ words[b[left] + depth]
            ends = differ != 0
            bits = np.frexp(differ[ends].astype(np.float64))[1]  # one too many at most, for 53-bit rounding up to a power of two
            bits -= (differ[ends] >> np.minimum(bits - 1, 63).astype(np.uint64)) == 0
            found[left[ends]] = np.minimum(most[left[ends]], depth + (64 - bits) // 8)
            left = left[~ends]
            depth += _WORD
        return found

    def long_matches(self, patterns: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset): where in the strings named a match of at least this length with an indexed one begins."""
        patterns = patterns[self.top[group[patterns]] >= 0]  # others have nothing to meet
        patterns = patterns[np.argsort(-self.strings.length[patterns], kind="stable")]
        out = [self._read(patterns[k : k + IN_STEP], group, least) for k in range(0, len(patterns), IN_STEP)]
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _read(self, patterns: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        strings, runs = self.strings, len(self.starts)
        length = strings.length[patterns]
        last = strings.start[patterns] + length - 1
        mine = group[patterns].astype(np.int64) * 256
        top = self.top[group[patterns]]
        top_at = self.first[np.searchsorted(self.starts, top, "right") - 1]
        row, at, matched = top.copy(), top_at.copy(), np.zeros(len(patterns), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(int(length.max(initial=0))):
            k = int(np.searchsorted(-length, -step, "left"))  # patterns longer than step: a prefix of them
            key = mine[:k] + strings.text[last[:k] - step]
            run = np.searchsorted(self.starts, row[:k], "right") - 1
            hit = self.key[run] == key
            row[:k] = self.to[run] + row[:k] - self.starts[run]
            at[:k] -= 1
            matched[:k] += 1
            miss = np.flatnonzero(~hit)
            if len(miss):
                was, had = at[miss] + 1, matched[miss] - 1
                spot = np.searchsorted(self.by_key, key[miss] * (runs + 1) + run[miss])
                above, below = self.runs_by_key[np.maximum(spot - 1, 0)], self.runs_by_key[np.minimum(spot, runs - 1)]
                kept = []
                for other, sample, there in ((above, self.last, spot > 0), (below, self.first, spot < runs)):
                    there = there & (self.key[other] == key[miss])
                    length_kept = np.where(there, 0, -1)
                    worth = np.flatnonzero(there & (had > 0))
                    length_kept[worth] = self.common(was[worth], sample[other[worth]], had[worth])
                    kept.append(length_kept)
                up = kept[0] >= kept[1]
                best, other = np.where(up, kept[0], kept[1]), np.where(up, above, below)
                none = best < 0
                row[miss] = np.where(none, top[miss], self.to[other] + np.where(up, self.lengths[other], 0))
                at[miss] = np.where(none, top_at[miss], np.where(up, self.last[other], self.first[other]) - 1)
                matched[miss] = np.where(none, 0, best + 1)
            long = np.flatnonzero(matched[:k] >= least)
            if len(long):
                found.append((patterns[long], (length[long] - 1 - step)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, offset = zip(*found)
        return np.concatenate(which), np.concatenate(offset)
