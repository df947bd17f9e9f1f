"""Joins of overlapping intervals, by bins.

Both sides are dealt to the bins that they touch and meet by an equi-join on the bin (and `by`), so no pair of rows that
are far apart is made. The bins' width is the mean length of both sides' intervals unless given: then all
intervals together touch about twice as many bins as there are rows, however long a few of them are. A
pair that shares several bins counts in the first that both touch, so nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_width(*sides: DataFrame, start: str = "start", end: str = "end") -> int:
    """The mean length of the intervals, 1 at least."""
    sums = [side.agg(F.coalesce(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0)).cast("decimal(38,0)")), F.lit(0)), F.count(F.lit(1))).first() for side in sides]
    return max(1, int(sum(s for s, _ in sums)) // max(1, sum(n for _, n in sums)))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows whose closed intervals overlap: the columns `by`, the left row as struct `l` and the right one as `r`.
    Starts and ends are whole numbers; an interval that ends before it starts or has a null end, and a null in
    `by`, meet nothing. Points are intervals of equal ends."""
    width = width or mean_width(left, right, start=start, end=end)
    bin_of = lambda at: F.floor(at / F.lit(float(width))).cast("long")

    def dealt(side: DataFrame, name: str) -> DataFrame:
        whole = side.where(F.col(start) <= F.col(end)).select(*by, F.struct(*side.columns).alias(name))
        return whole.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(name)[start]), bin_of(F.col(name)[end]))))

    pairs = dealt(left, "l").join(dealt(right, "r"), [*by, "_bin"])
    first = F.col("_bin") == bin_of(F.greatest(F.col("l")[start], F.col("r")[start]))
    return pairs.where(first & (F.col("l")[start] <= F.col("r")[end]) & (F.col("r")[start] <= F.col("l")[end])).select(*by, "l", "r")


def within(left: DataFrame, right: DataFrame, distance: int, at: str, by: list[str]) -> DataFrame:
    """Pairs of rows whose `at` differ by `distance` at most."""
    reach = lambda side, d: side.withColumns({"_start": F.col(at) - d, "_end": F.col(at) + d})
    return overlap_join(reach(left, distance), reach(right, 0), by, max(1, 2 * distance), "_start", "_end")


def flat(pairs: DataFrame, left: dict[str, str], right: dict[str, str], *more: Column | str) -> DataFrame:
    """The pairs' columns by new names: left and right map a new name to a side's column."""
    return pairs.select(*more, *[F.col("l")[c].alias(n) for n, c in left.items()], *[F.col("r")[c].alias(n) for n, c in right.items()])
