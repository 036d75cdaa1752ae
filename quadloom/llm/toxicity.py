"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words and their character n-grams share hashed embedding rows, so a misspelling never seen in
training still lands on most of the n-grams of the word it disguises. There are two heads: one
averages over the whole text, which finds toxic ways of speaking that run all through it; the other
over windows of words, the worst window speaking for the text, so a few toxic words in a text of
20,000 count as much as in a text of 50. The score is the chance that one of them is right; a head
that does no good on rows of the sample set aside for that is left out.

Defined results: null, empty and blank texts get the score of the biases alone; repeated rows get
equal scores; texts of any length are scored whole; a null doc_id is scored like any other; an
empty table gives no rows; extra columns pass through, but for those of the result's names (score,
predicted), which the result replaces. With labels of one class every text gets that share as its
score; without labelled rows every text scores next to nothing, so none is called toxic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import classify, subword
from quadloom.llm.common import let_go

#: At most so many labelled rows of either class are learnt from.
PER_CLASS = 2500
HEADS = [subword.Head(prior=1000, epochs=12, rate=1.5), subword.Head(window=12)]
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS, heads: list[subword.Head] = HEADS) -> subword.Model:
    texts, marks, share = classify.training_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, per_class)
    model = subword.fit(texts, marks, subword.best_heads(texts, marks, heads, THRESHOLD, fold_case=True, share=share), fold_case=True, unknown=0.0, share=share)
    let_go()  # the driver lives on
    return model


def score(docs: DataFrame, model: subword.Model) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from THRESHOLD up)."""
    return classify.scored(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
