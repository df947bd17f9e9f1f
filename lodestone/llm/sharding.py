"""Hierarchical weighted hash tree: region, rack and shard are drawn in turn by weighted hash draws.

A row meets each region as a sequence of points in time, by hashes of its key, the region and the point's number.
A point falls to a rack of the region by one hash draw, to a shard of the rack by another, and on a height between
0 and `most` by a third; it counts if it is below the shard's weight. The time of a region's first point that
counts is the region's draw: exponential with the sum of the weights below. The row goes to the region with the least
draw, and there to the rack and shard of that point. Only points earlier than the best so far are drawn, and
a region of 2 k shards has no more racks to look at than one of k, so a row costs some draws a region: the
regions hold `region` racks, as many again, then twice as many each, 9 regions for 1,000 shards.

Neither a place nor a time depends on the weights or on the number of shards, they only decide which points count. So
a changed weight moves rows only into or out of the shard that has it, within the subtrees on its path, and one more
shard takes rows only into itself, at every number of shards.

Defined cases: null ids all draw like the id "null"; repeated ids share a shard; a shard of weight 0 takes
no row; weights below 0, over `most` or all 0 are an error; slots number the rows of a shard from 0 without
gaps, in the order of a hash of id, size and checksum, then of these, equal rows in any order; a null text has
size 1 and checksum 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task numbers, about.
SLOT_ROWS = 50_000
#: Shards of a rack, racks of the first two regions, and the greatest weight.
RACK, REGION, MOST = 4, 2, 4.0

PLACE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown", T.IntegerType())])


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(keys: np.ndarray, region: int, point: int, what: int) -> np.ndarray:
    """Numbers from 0 up to 1 by key, region, point and what is drawn: time, rack, shard or height."""
    salt = mixed(np.array([((region << 40) + (point << 3) + what + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))
    return (mixed(mixed(keys) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53


def regions(n: int, rack: int, region: int) -> Iterator[tuple[int, int]]:
    """First shard and number of racks of the regions that `n` shards reach."""
    first, racks = 0, region
    while first < n:
        yield first, racks
        racks = region if first == 0 else 2 * racks
        first = rack * region if first == 0 else 2 * first


def places(keys: np.ndarray, weights: list[float], rack: int = RACK, region: int = REGION, most: float = MOST) -> np.ndarray:
    """The shard of each 64-bit key."""
    if not weights or min(weights) < 0 or max(weights) > most or not sum(weights):
        raise ValueError(f"weights from 0 to {most}, not all 0, are wanted")
    weight, best, shard = np.array(weights, float), np.full(len(keys), np.inf), np.full(len(keys), -1, np.int32)
    for number, (first, racks) in enumerate(regions(len(weights), rack, region)):
        if not weight[first : first + racks * rack].any():
            continue
        left, time, point = np.arange(len(keys)), np.zeros(len(keys)), 0
        while len(left):
            k = keys[left]
            time = time - np.log1p(-draw(k, number, point, 0)) / (racks * rack * most)
            early = time < best[left]
            left, time, k = left[early], time[early], k[early]
            at = first + (draw(k, number, point, 1) * racks).astype(np.int64) * rack + (draw(k, number, point, 2) * rack).astype(np.int64)
            counts = (at < len(weight)) & (draw(k, number, point, 3) * most < weight[np.minimum(at, len(weight) - 1)])
            best[left[counts]], shard[left[counts]] = time[counts], at[counts]
            left, time, point = left[~counts], time[~counts], point + 1
    return shard


def place(key: Column, weights: list[float], rack: int = RACK, region: int = REGION, most: float = MOST) -> Column:
    """struct(shard, grown) of a key: with these weights, and with one shard more, of their mean."""
    weights = list(map(float, weights))
    grown = [*weights, sum(weights) / len(weights)]

    def run(column: pa.Array) -> pa.Array:
        keys = np.asarray(column, np.int64).view(np.uint64)
        return pa.StructArray.from_arrays([pa.array(places(keys, w, rack, region, most)) for w in (weights, grown)], names=PLACE.names)

    return F.arrow_udf(run, PLACE)(F.xxhash64(key))


def assign(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, rack: int = RACK, region: int = REGION, most: float = MOST) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `df`. The next shard has the
    mean weight of those before."""
    weights = list(weights or [1.0] * n_shards)
    n_shards = len(weights)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("_place", place(F.col("_key"), weights, rack, region, most))
    rows = rows.select("*", F.col("_place.shard").alias("shard"), F.col("_place.grown").alias("grown_shard")).drop("_place")
    # Slots: rows are numbered inside bins of a shard, and each bin starts where those before it end.
    # Bins come from all that tells rows apart, so repeated ids spread as well as their texts do.
    digits, total = 1, df.count()
    while 16**digits * n_shards * SLOT_ROWS < total:
        digits += 1
    rows = rows.withColumn("_bin", F.substring(F.md5(F.concat_ws("/", "_key", "size", "text_crc32")), 1, digits))
    sums = rows.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("n"))
    starts = sums.withColumn("start", F.sum("n").over(W.partitionBy("shard").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))).select("shard", "_bin", F.coalesce("start", F.lit(0)).alias("start"))
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("shard", "_bin").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(starts, ["shard", "_bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard")
