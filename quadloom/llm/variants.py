"""Spelling variants: each word's near words, the form it most likely stands for, and the root of its forms.

Two words are near if one code point inserted, deleted or replaced turns one into the other. Pairs
of words are never listed. For replacements every word joins one wildcard group for each of its
positions, keyed by (position, prefix, suffix); a group keeps its size and its two best words, which
gives each member the number of its neighbours there and the best of them (the second, for the best
itself). A group has at most one word for each letter of the alphabet, 90 here, so no group grows
with the data. For insertions and deletions the words with one code point left out are joined with
the vocabulary itself, at most one row for each letter of the longer word. What a word gets from its
groups and from both sides of that join is added up by one aggregate.

A word's form has at least twice its count, so a path of forms has at most log2(largest count)
steps and pointer doubling ends after the logarithm of that many joins.

Everything is DataFrame code; counts go through partial aggregates, so a frequent word is no hot key.

Defined results: null, empty and letterless texts have no runs; repeated rows count each time; a
null doc_id hashes as an empty one; ties in count are settled by code-point order; long texts are
read whole; an empty table has no words; extra columns of any name are left out.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import checkpointed

#: A run of letters; the range holds U+00D7 and U+00F7 too.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One occurrence in so many loses a letter, chosen by hash.
LOSES = 97


def without(word: str, at: str) -> Column:
    """The word less its code point at this place, counted from 1."""
    return F.expr(f"concat(substring({word}, 1, {at} - 1), substring({word}, {at} + 1))")


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): what words become after the letters they lose, of LEAST_LENGTH code points and LEAST_COUNT occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    lost = without("run", "cast(h % length(run) as int) + 1")
    words = hashed.select(F.when(F.col("h") % LOSES == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def replaced(words: DataFrame) -> DataFrame:
    """(word, near, n, other): words near by a replacement at one position, and the best of them with its count."""
    spots = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    keyed = spots.select("word", "n", "at", F.expr("substring(word, 1, at - 1)").alias("prefix"), F.expr("substring(word, at + 1)").alias("suffix"))
    group, best = "partition by at, prefix, suffix", "order by n desc, word"
    frame = f"over ({group} {best} rows between unbounded preceding and unbounded following)"
    met = keyed.selectExpr("word", f"count(*) {frame} as size", f"first_value(struct(n, word)) {frame} as first", f"nth_value(struct(n, word), 2) {frame} as second")
    other = F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first"))
    return met.filter("size > 1").select("word", (F.col("size") - 1).alias("near"), other["n"].alias("n"), other["word"].alias("other"))


def shifted(words: DataFrame) -> DataFrame:
    """As replaced, for words near by an insertion or a deletion: a row for the longer and one for the shorter."""
    spots = words.filter(F.length("word") > LEAST_LENGTH).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    # Leaving out any letter of a row of equal ones gives one word: the first of the row stands for all.
    spots = spots.filter("at = 1 or substring(word, at, 1) <> substring(word, at - 1, 1)")
    cut = spots.select(F.col("word").alias("longer"), F.col("n").alias("n_longer"), without("word", "at").alias("word"))
    met = cut.join(words, "word").select(F.col("word").alias("shorter"), F.col("n").alias("n_shorter"), "longer", "n_longer")
    sides = F.array(
        F.struct(F.col("longer").alias("word"), F.col("n_shorter").alias("n"), F.col("shorter").alias("other")),
        F.struct(F.col("shorter").alias("word"), F.col("n_longer").alias("n"), F.col("longer").alias("other")),
    )
    return met.select(F.explode(sides).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.n", "x.other")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, form) -> (word, root): the last form on the path; most bounds every word's count."""
    steps = max(1, math.floor(math.log2(max(2, most))))
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps + 1)))):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        reached = checkpointed(reached.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root")))
    return reached


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (doc_id, text)."""
    words = checkpointed(counted(docs))
    best = F.min(F.struct((-F.col("n")).alias("minus"), "other")).alias("best")
    near = replaced(words).unionByName(shifted(words)).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= FACTOR * F.col("n"), F.col("best")).alias("best"))
    told = checkpointed(told.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.minus")).cast("long").alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    last = roots(told.filter("form is not null").select("word", "form"), most)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
