"""Quality: supervised subword embeddings, averaged per document, softmax output, trained in numpy.

Hashed word and character n-gram vectors are learnt with the softmax by stochastic gradient
descent. Case is kept, since shouting is a mark of poor text, and a word that repeats the one
before it counts as a feature of its own.

Defined results: as for toxicity, but without labelled rows every text scores next to 1, so that none
is called poor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import classify, subword
from quadloom.llm.common import let_go

#: At most so many labelled rows of either class are learnt from.
PER_CLASS = 2000
HEADS = [subword.Head(epochs=12, rate=1.5)]
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS, heads: list[subword.Head] = HEADS) -> subword.Model:
    texts, marks, _ = classify.training_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, per_class)
    model = subword.fit(texts, marks, heads, fold_case=False, unknown=1.0)
    let_go()  # the driver lives on
    return model


def score(docs: DataFrame, model: subword.Model) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from THRESHOLD up)."""
    return classify.scored(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
