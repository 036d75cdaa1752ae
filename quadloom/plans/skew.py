"""Joins whose many rows may have few keys, and rows dealt evenly to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.fixpoint import checkpointed

#: Rows of one key from which on it is met by a broadcast instead of a shuffle by key.
MANY = 10_000


def skewed_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined ('inner' or 'left_semi') with a table of few rows a key, whatever share of many one key has.

    The keys of over MANY rows are at most a MANY-th of the rows; what few holds of them is broadcast, so that
    their rows stay where they are. All other rows are joined as Spark chooses. many is read three times.
    """
    heavy = checkpointed(many.groupBy(*keys).count().filter(F.col("count") > MANY).select(*keys))
    if heavy.isEmpty():
        return many.join(few, keys, how)
    frequent = many.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(few.join(F.broadcast(heavy), keys, "left_semi")), keys, how)
    return frequent.unionByName(many.join(F.broadcast(heavy), keys, "left_anti").join(few, keys, how))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as a shuffle has, for work that takes long for its bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
