"""Windows over the whole table, without a task that sees all of it.

What depends on the order's value alone is computed on the distinct values: they are counted with map-side sums,
summed up range by range, and each row gets its value's result by a join in which frequent values are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.rows import number
from lodestone.operators.skew import HOT, join_hot
from lodestone.tables import materialize


def running_sums(df: DataFrame, sums: dict[str, str], *order: str) -> DataFrame:
    """`df` with the sums over all rows before each in a total order: new name -> column. Ranges are summed by
    themselves and shifted by the totals of those before; that table has a row a range."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    return out.join(F.broadcast(totals), "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def _by_value(df: DataFrame, value: str, results: DataFrame, names: list[str], total: int) -> DataFrame:
    """`df` with its value's results; a null value stands for itself."""
    key = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("v"))
    one = results.select(key(value).alias("_key"), *names, "_n")
    hot = one.where(F.col("_n") * HOT > total).select("_key")
    rows = df.select(F.struct(*df.columns).alias("_row"), key(value).alias("_key"))
    # Keys are compared as structs, whose null fields are not equal: the flag and a filled value are.
    filled = lambda d: d.withColumn("_key", F.to_json("_key"))
    return join_hot(filled(rows), filled(one), "_key", filled(hot)).select("_row.*", *names)


def ranks(df: DataFrame, value: str) -> DataFrame:
    """`df` with rank, dense_rank, percent_rank and cume_dist of `value` over all rows, ascending, nulls first."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1).cast("long"))
    summed = materialize(running_sums(counts, {"_before": "_n", "_values": "_one"}, value), "values")
    total = summed.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    of = F.lit(float(max(1, total)))
    out = summed.withColumns({
        "rank": F.col("_before") + 1, "dense_rank": F.col("_values") + 1, "percent_rank": F.col("_before") / F.lit(float(max(1, total - 1))), "cume_dist": (F.col("_before") + F.col("_n")) / of})
    return _by_value(df, value, out, ["rank", "dense_rank", "percent_rank", "cume_dist"], total)


def ntile(df: DataFrame, n: int, *order: str, name: str = "tile") -> DataFrame:
    """`df` with the tile from 1 to `n` of each row in a total order; the first tiles hold one row more where the number
    of rows is no multiple of `n`."""
    total = df.count()
    size, more = divmod(total, n)
    at = F.col("_pos")
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(1, size)))
    return number(df, *order, name="_pos").withColumn(name, (tile + 1).cast("int")).drop("_pos")


def range_frame(df: DataFrame, at: str, reach: int, value: str) -> DataFrame:
    """`df` with frame_n, frame_sum, frame_min and frame_max of `value` over the rows whose `at`, a whole number, is within
    `reach`. Distinct places are summed first and go to three bins of that width, so a bin's window sees no more than the
    places around it. A null `at` is with its like only."""
    sums = df.groupBy(at).agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_c"), F.sum(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    sums = materialize(sums, "places")
    home = F.floor(F.col(at) / F.lit(float(max(1, reach)))).cast("long")
    bins = sums.withColumn("_home", home).withColumn("_bin", F.explode(F.when(home.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(home - 1, home, home + 1))))
    near = W.partitionBy("_bin").orderBy(at).rangeBetween(-reach, reach)
    framed = bins.withColumns({"frame_n": F.sum("_c").over(near), "frame_sum": F.sum("_s").over(near), "frame_min": F.min("_lo").over(near), "frame_max": F.max("_hi").over(near)})
    framed = framed.where(F.col("_bin").eqNullSafe(F.col("_home")))
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return _by_value(df, at, framed, ["frame_n", "frame_sum", "frame_min", "frame_max"], total)
