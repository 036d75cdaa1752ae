"""Connected components of a graph of edges, by alternating large and small stars.

Every step is an aggregate (a minimum) and a join on thin rows, so neither a hub nor a component is
ever gathered in one task; rounds grow with the logarithm of the longest path. Before the first
round each task contracts its own edges, and after each round the edges go to the shared folder. Up to FEW_EDGES contracted edges (a few MB, counted first)
are finished by one task instead; beyond that number the rounds do it, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import checkpointed, tidy

CHUNK_EDGES = 2_000_000
FEW_EDGES = 250_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task -> (node, smallest node that the task's edges reach from it)."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while (up := above.get(x, x)) != top:
            above[x] = top
            x = up
        return top

    def stars() -> pd.DataFrame:
        pairs = [(x, root(x)) for x in above if root(x) != x]
        above.clear()
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
                above.setdefault(min(a, b), min(a, b))
        if len(above) > CHUNK_EDGES:
            yield stars()
    yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """edges -> (node, component), component being the smallest node reachable; only nodes with edges.

    contracted: the tasks that make the edges return forests already, so they aren't contracted
    again (a second Python worker would run beside the one that makes them). Self edges and repeated edges do no harm; null ends are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    if contracted:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        pairs = pairs.mapInPandas(_contract, "a long, b long")
    stars = checkpointed(pairs.distinct())
    if stars.count() <= FEW_EDGES:
        stars = checkpointed(stars.coalesce(1).mapInPandas(tidy(_contract), "a long, b long"))
    for _ in range(most_rounds):
        # Done when every node has one edge, to a node that has none of its own.
        twice = stars.groupBy("a").count().filter("count > 1").select("a")
        chained = stars.select(F.col("b").alias("a")).join(stars.select("a"), "a", "left_semi")
        if twice.unionAll(chained).isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        stars = checkpointed(small)
    raise RuntimeError("components did not settle")
