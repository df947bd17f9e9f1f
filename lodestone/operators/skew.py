"""Joins with one row a key when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more than one in HOT of all rows are hot, so there are fewer than HOT of them.
HOT = 1000


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys of `rows` that hold more than one in HOT of them, to be broadcast."""
    return hot_of(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, total)


def hot_of(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The same of counts(key, _n)."""
    return counts.where(F.col("_n") * HOT > total).select(key)


def join_hot(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with `one` (one row a key). Rows of hot keys stay where they are and their partners are
    broadcast, fewer than HOT; all others meet by a shuffle on the key."""
    few = F.broadcast(hot)
    still = rows.join(few, key, "left_semi").join(F.broadcast(one.join(few, key, "left_semi")), key)
    return still.unionByName(rows.join(few, key, "left_anti").join(one, key))
