"""Token counts that follow edits.

A document is kept as the pre-tokens that the tokenizer's pattern cuts it into, with the number of
tokens of each, in blocks of up to BLOCK leaves under a segment tree of sums (characters, tokens).
An edit descends to its place, takes the leaves it touches and a few before them as context, cuts
that stretch anew, and goes on only until a new cut falls on an old one behind the edit: the
pattern looks ahead but never back, so from there on nothing can differ. Then sums are updated on
the paths above. The count of an edited document is the root's, without reading the rest again.

Defined results: a null text is empty; edits beyond the end are applied at the end, negative
positions at 0; null edits and null members are no edit; repeated rows are counted alike; extra
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.chat_tree import encoder
from quadloom.llm.common import small_batches

BLOCK = 256
#: Leaves before an edit that may change with it: one that the edit lengthens, and the white space before it.
CONTEXT = 3
CACHE_LEAVES = 250_000

COUNTS = "n_tokens long, n_tokens_edited long, n_chars_edited long, n_edits long, reread_chars long"


class Counter:
    """Pre-tokens of a text, and tokens of a pre-token, for one tokenizer."""

    def __init__(self, ranks: str, pattern: str):
        white = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(white)
        self.encode = encoder(ranks).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, leaves: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[x] for x in leaves]
        except KeyError:
            if len(known) > CACHE_LEAVES:
                known.clear()
            for x in leaves:
                if x not in known:
                    known[x] = len(self.encode(x))
            return [known[x] for x in leaves]

    def total(self, text: str | None) -> int:
        return sum(self.counts(self.pattern.findall(text))) if text else 0


class Tree:
    """Leaves of one document under sums of characters and tokens."""

    def __init__(self, text: str | None, counter: Counter):
        self.counter, self.reread = counter, 0
        leaves = counter.pattern.findall(text) if text else []
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self._build()

    def _build(self) -> None:
        self.wide = 1
        while self.wide < len(self.blocks):
            self.wide *= 2
        self.chars, self.tokens = [0] * (2 * self.wide), [0] * (2 * self.wide)
        for i, block in enumerate(self.blocks):
            self._sum(i)
        for i in range(self.wide - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _sum(self, block: int) -> None:
        leaves = self.blocks[block]
        self.chars[self.wide + block] = sum(map(len, leaves))
        self.tokens[self.wide + block] = sum(self.counter.counts(leaves))

    def _update(self, block: int) -> None:
        self._sum(block)
        i = (self.wide + block) // 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(x for block in self.blocks for x in block)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block and leaf that hold a character (the last ones for the end), and where the leaf begins."""
        i, begin = 1, 0
        while i < self.wide:
            i *= 2
            if at - begin >= self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        block = min(i - self.wide, len(self.blocks) - 1)
        leaves = self.blocks[block]
        for k, leaf in enumerate(leaves):
            if at < begin + len(leaf):
                return block, k, begin
            begin += len(leaf)
        return block, len(leaves), begin

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(at, 0), self.n_chars)
        end = min(at + max(remove, 0), self.n_chars)
        first, k, begin = self._find(at)
        back = CONTEXT if k < len(self.blocks[first]) else CONTEXT + 1
        while back and (k or first):
            if k == 0:
                first -= 1
                k = len(self.blocks[first])
                continue
            k -= 1
            begin -= len(self.blocks[first][k])
            back -= 1
        # Old cuts from here on, taken as they are needed.
        last, m, old_at = first, k, begin
        tail: list[str] = []  # old leaves read so far

        def more() -> bool:
            nonlocal last, m, old_at
            while m >= len(self.blocks[last]):
                if last + 1 >= len(self.blocks):
                    return False
                last, m = last + 1, 0
            tail.append(self.blocks[last][m])
            old_at += len(tail[-1])
            m += 1
            return True

        while old_at < end and more():
            pass
        shift, ahead = len(insert) - (end - at), 8
        while True:
            for _ in range(ahead):
                if not more():
                    break
            whole = "".join(tail)
            new = whole[: at - begin] + insert + whole[end - begin :]
            ended = last == len(self.blocks) - 1 and m >= len(self.blocks[last])
            cuts, old, old_cuts = begin, begin, {}
            for n, leaf in enumerate(tail):
                old += len(leaf)
                if old >= end:
                    old_cuts[old + shift] = n + 1
            fresh, kept = [], len(tail)
            for leaf in self.counter.pattern.findall(new):
                fresh.append(leaf)
                cuts += len(leaf)
                # The last few cuts of a stretch may depend on what follows it.
                if cuts >= at + len(insert) and cuts in old_cuts and (old_cuts[cuts] <= len(tail) - 4):
                    kept = old_cuts[cuts]
                    break
            else:
                if not ended:
                    ahead *= 4
                    continue
            break
        self.reread += sum(map(len, fresh))
        # Where the old leaves end that the fresh ones stand for.
        last, m, left = first, k, kept
        while left:
            room = len(self.blocks[last]) - m
            if left <= room:
                m += left
                left = 0
            else:
                left -= room
                last, m = last + 1, 0
        merged = self.blocks[first][:k] + fresh + self.blocks[last][m:]
        if first == last and len(merged) <= 2 * BLOCK:
            self.blocks[first] = merged
            self._update(first)
        else:
            self.blocks[first : last + 1] = [merged[i : i + BLOCK] for i in range(0, len(merged), BLOCK)] or [[]]
            self._build()


def counted(docs: DataFrame, edits: str, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """docs plus the columns of COUNTS, without text and edits.

    edits names a column of array<struct<at:int, remove:int, insert:string>>, applied in order, each
    to the text that those before it left. Narrow: no shuffle; a task holds one tree at a time.
    """

    small_batches(docs.sparkSession)
    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks, pattern)
        for texts, lists in batches:
            rows = []
            for body, changes in zip(texts, lists):
                tree = Tree(body, counter)
                before, n = tree.n_tokens, 0
                for change in changes if changes is not None else ():
                    if change is None or change["at"] is None:
                        continue
                    tree.edit(int(change["at"]), int(change["remove"] or 0), change["insert"] or "")
                    n += 1
                rows.append((before, tree.n_tokens, tree.n_chars, n, tree.reread))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COUNTS.split(", ")])

    names = [x.split()[0] for x in COUNTS.split(", ")]
    others = [c for c in docs.columns if c not in (text, edits, *names)]
    return docs.withColumn("_counts", count(F.col(text), F.col(edits))).select(*others, *[F.col(f"_counts.{x}").alias(x) for x in names])
