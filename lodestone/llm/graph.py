"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.skew import join_groups
from lodestone.tables import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows(u, v) with m, the least v of their u. Minima combine on the map side; a hub's rows stay where they are and its
    minimum is broadcast, as that of any node of more than a thousandth of the rows."""
    least = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return join_groups(rows, least, ["u"], "n", total).drop("n")


def components(links: DataFrame) -> DataFrame:
    """node, label for every end of `links` (u, v): the label is the component's smallest node. Each
    round is two aggregations and joins. Self-links and nulls say nothing and are left out."""
    edges = materialize(links.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    before = None
    while (mark := _mark(edges)) != before:
        before = mark
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        small = _with_least(large, large.count()).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
