"""Numbering, splitting and sampling rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.tables import materialize


def number(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """`df` with the 0-based position of each row in the given total order. Ranges are numbered by
    themselves and shifted by the sizes of those before; the table of sizes has a row per range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def hash_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random place that every engine with md5 computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_by_shares(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42, name: str = "split") -> DataFrame:
    """Exact shares of a seeded order, cut where Python's int() truncates n times the running share."""
    placed = number(df.withColumn("_place", hash_order(F.col(key), seed)), "_place", key, name="_pos").drop("_place")
    n, upto, label = df.count(), 0.0, None
    names = list(shares)
    for k in names[:-1]:
        upto = round(upto + shares[k], 9)
        label = F.when(F.col("_pos") < int(n * upto), k) if label is None else label.when(F.col("_pos") < int(n * upto), k)
    return placed.withColumn(name, label.otherwise(names[-1])).drop("_pos")


def chunk(pos: Column, n: int, k: int) -> Column:
    """Chunk of a position: k chunks of n // k rows, the remainder in the last."""
    return F.least(F.floor(pos / max(1, n // k)), F.lit(k - 1)).cast("int")


def first(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order, for a look or a test run: each task sends n rows at most."""
    return df.orderBy(*order).limit(n)
