"""Transitive closure by semi-naive rounds of DataFrame joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder all executors share (spark.checkpoint.dir; one of our own where unset)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint()


#: Edges that one list holds; so many reach FEW * FEW pairs at most.
FEW = 300
#: Rounds whose pairs stay as they were written, before they are written together.
PIECES = 16


def _pairs(edges: list[tuple]) -> list[tuple]:
    """All pairs joined by one edge or more."""
    after: dict = {}
    for s, o in edges:
        after.setdefault(s, []).append(o)
    out = []
    for s in after:
        seen, todo = set(), list(after[s])
        while todo:
            o = todo.pop()
            if o not in seen:
                seen.add(o)
                todo += after.get(o, ())
        out += [(s, o) for o in seen]
    return out


def closure(edges: DataFrame, seeds: DataFrame | None = None, backwards: bool = False, most_rounds: int = 10_000) -> DataFrame:
    """Pairs (s, o) joined by one edge or more; cycles end when a round finds nothing new.

    Without seeds each round joins what is new with all that is known, so reach doubles; with seeds
    it takes one edge more, so nothing is found that no seed reaches. Where no node has two edges onward,
    as in chains, steps from seeds double too: there are never more of them than edges. Pairs are
    written as they are found, not again in each round.

    seeds (one column s) keeps the pairs that start there, so a path from a constant never computes
    the whole closure; with backwards, seeds are ends instead (column o).

    Up to FEW edges, as a schema has, are followed on the driver instead of in rounds of jobs.
    """
    edges = edges.select("s", "o").distinct()
    if backwards:
        flipped = edges.selectExpr("o as s", "s as o")
        ends = seeds.selectExpr("o as s") if seeds is not None else None
        return closure(flipped, ends, False, most_rounds).selectExpr("o as s", "s as o")
    edges = checkpointed(edges)
    few = edges.limit(FEW + 1).collect()
    if len(few) <= FEW:
        found = edges.sparkSession.createDataFrame(_pairs([(r.s, r.o) for r in few]), edges.schema)
        return found if seeds is None else found.join(seeds.select("s").distinct(), "s", "left_semi")
    step = edges.selectExpr("s as _m", "o as _n")
    known = delta = checkpointed(edges.join(seeds.select("s").distinct(), "s", "left_semi") if seeds is not None else edges)
    leaps = seeds is not None and edges.groupBy("s").count().filter("count > 1").isEmpty()
    for n in range(1, most_rounds + 1):
        onward = step if seeds is not None else known.selectExpr("s as _m", "o as _n")
        found = (known if leaps else delta).join(onward, F.col("o") == F.col("_m")).selectExpr("s", "_n as o").distinct()
        delta = checkpointed(found.join(known, ["s", "o"], "left_anti"))
        if delta.isEmpty():
            return known
        known = known.unionAll(delta)
        if leaps:
            step = checkpointed(step.join(step.selectExpr("_m as _k", "_n as _l"), F.col("_n") == F.col("_k")).selectExpr("_m", "_l as _n"))
            if step.isEmpty():
                return known
        if n % PIECES == 0:
            known = checkpointed(known)
    raise RuntimeError("closure did not settle")
