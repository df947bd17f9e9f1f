"""As-of join: each left row with the last right value of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Both sides meet in one window by key, ordered by time with right rows first at equal times."""
    names = [c for c in left.columns if c not in (key, time)]
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select(key, time, *names, value)
