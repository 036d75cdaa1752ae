"""Spelling variants against a comparison of every two words, on small and awkward tables."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quadloom.llm import queries, variants

DOCS = "doc_id long, text string, word string, n string, at string"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best is not None and n[best] >= 2 * n[w] else None, len(others)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] is not None else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], DOCS)


def test_against_every_pair(spark):
    rng = random.Random(2)
    roots = ["".join(rng.choice("abé×ÿ") for _ in range(rng.randint(4, 8))) for _ in range(25)]
    words = []
    for _ in range(2500):
        w = list(rng.choice(roots))
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "É", "aa"])
        words.append("".join(w).upper().replace("É", "é") if rng.random() < 0.2 and "ÿ" not in w else "".join(w))
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(125)]
    rows += [(None, "aaaaab aaaaab"), (None, "aaaaab"), (7, None), (8, ""), (9, "12 -- 3"), (10, rows[3][1]), (10, rows[3][1]), (11, "fivers " * 5000)]
    want = plain(rows)
    assert len(want) > 50 and any(x[1] is not None for x in want)
    assert got(variants.grouped(table(spark, rows))) == want


def test_chains_ties_and_letters_that_repeat(spark):
    counts = {"aaaaa": 200, "aaaaab": 90, "aaaabb": 40, "aaabbb": 18, "aabbbb": 8, "abbbbb": 3, "zzzzz": 6, "zzzzy": 12, "zzzzx": 12, "zzzzzz": 3, "mmmmmmm": 3, "mmmmmm": 3}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    want = plain(rows)
    assert got(variants.grouped(table(spark, rows))) == want
    of = {x[0]: x for x in want}
    assert of["zzzzz"][1] == "zzzzx" and of["mmmmmmm"][4] == 1 and of["abbbbb"][2] == "aaaaa"


def test_roots_need_few_rounds(spark):
    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(40)], "word string, form string")
    assert {r.root for r in variants.roots(forms, 2**41).collect()} == {"w40"}


def test_empty(spark):
    assert got(variants.grouped(table(spark, []))) == [] and got(variants.grouped(table(spark, [(1, None)]))) == []


def test_registered_query_is_native(spark):
    plan = queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    spots = variants.replaced(variants.counted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert spots.filter(F.col("near") >= 90).isEmpty()  # no group beyond the alphabet
