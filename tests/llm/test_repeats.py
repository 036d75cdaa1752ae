"""Repeated byte strings: the index against plain search, the operator against every window."""

import hashlib
import random
import time

import numpy as np
import pytest

from quadloom.llm import repeats
from quadloom.llm.run_index import RunIndex, Strings

DOCS = "doc_id long, text string, at string, marks string, tie string"


def strings(rng):
    alphabet, base = rng.choice(["ab", "abc", "abcdefgh"]), None
    base = "".join(rng.choice(alphabet) for _ in range(40))
    out = []
    for _ in range(rng.randint(2, 12)):
        at = rng.randrange(40)
        s = list(base[at : at + rng.randint(1, 40)])
        for _ in range(rng.choice([0, 0, 1, 3])):
            s[rng.randrange(len(s))] = rng.choice(alphabet)
        out.append("".join(s).encode())
    return out


def test_suffix_order_and_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        some = strings(rng)
        made = Strings(some)
        text = made.text.tobytes()
        assert made.order.tolist() == sorted(range(len(text)), key=lambda i: (text[i : text.index(b"\xff", i) + 1], i))
        member, group = np.array([rng.random() < 0.5 for _ in some]), np.array([rng.randint(0, 2) for _ in some])
        index, asked = RunIndex(made, member, group), np.flatnonzero(~member)
        for least in (1, 3, 5, 9):
            found = set(zip(*(x.tolist() for x in index.long_matches(asked, group, least))))
            assert found == {(i, j) for i in asked.tolist() for j in range(len(some[i]) - least + 1) if any(member[x] and group[x] == group[i] and some[i][j : j + least] in some[x] for x in range(len(some)))}


def test_runs_are_few_in_repetitive_text():
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(150))
    made = Strings([base] * 300)
    index = RunIndex(made, np.ones(300, bool), np.zeros(300, np.int64))
    assert len(index.starts) < 2 * 151 and len(made.text) == 300 * 151


def plain(rows):
    """By every window of every document, in order of doc_id."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        marked = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                marked[i : i + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for i, x in enumerate(marked) if x and (i == 0 or not marked[i - 1]))
        out.append((doc, len(data), sum(marked), spans, hashlib.sha256(bytes(x for x, k in zip(data, marked) if not k)).hexdigest()))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    known = [word() for _ in range(60)]
    base = [" ".join(rng.choice(known) for _ in range(rng.randint(5, 300))) for _ in range(25)]
    line, rows = " ".join(rng.choice(known) for _ in range(14)), []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            words[rng.randrange(len(words))] = rng.choice(known) + "x"
        text = " ".join(words)
        text = text[: len(text) // 2] + line + text[len(text) // 2 :] if rng.random() < 0.5 else text
        text += "a" * rng.randint(50, 700) if rng.random() < 0.1 else ""
        rows.append((i, text + text[: len(text) // 2] if rng.random() < 0.1 else text))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 99), (1003, "b" * 100), (1004, "b" * 100), (1005, "ab" * 500), (-5, rows[0][1])]


def got(spark, rows, **more):
    out = repeats.deduplicated(spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS), **more)
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r)[:5] for r in out.collect()), key=repr)


@pytest.mark.parametrize("most", [0, 2, repeats.MOST])
def test_against_every_window(spark, most):
    """Also with every minimizer, or every one of three pieces, taken for hot and dealt window by window."""
    rows = corpus(1)
    assert got(spark, rows, most=most) == sorted(plain(rows), key=repr)


def test_many_partitions_and_small_shards(spark, monkeypatch):
    """Every partition and shard holds a few rows, so most minimizers lie on edges."""
    monkeypatch.setattr(repeats, "ROWS", 40)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rows = corpus(2, 40)
    assert got(spark, rows) == sorted(plain(rows), key=repr)


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = "The first text. " * 10, "Another, of its own words and longer than a hundred bytes, so that it has windows; it says nothing twice at all."
    out = got(spark, [(1, b), (1, b), (2, a), (2, b), (None, b), (None, None)])
    of = lambda doc, n: [r[2] for r in out if r[0] == doc and r[1] == n]
    assert of(1, len(b)) == [0, 0] and of(2, len(b)) == [len(b)] and of(None, len(b)) == [len(b)] and of(None, 0) == [0]
    assert got(spark, []) == []


def test_spans_say_what_goes(spark):
    rows = corpus(3, 20)
    texts = {d: (t or "").encode() for d, t in rows}
    for r in repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        kept, last = b"", 0
        for start, stop in r.spans:
            assert stop - start >= 100 and (start > last or start == 0)
            kept, last = kept + texts[r.doc_id][last:start], stop
        assert hashlib.sha256(kept + texts[r.doc_id][last:]).hexdigest() == r.kept_sha256


def test_long_texts_of_one_letter_take_linear_time():
    began = time.process_time()
    at, windows, _, _ = repeats.pieces(np.frombuffer(b"a" * 1_000_000, np.uint8))
    assert windows.sum() == 1_000_000 - 99 and time.process_time() - began < 20
