"""Structured Streaming: each file once, windows and sessions with a watermark, and repeated keys dropped.

A stream runs to the end of what is there (availableNow) into a Parquet folder with a checkpoint, both
in the shared folder, and the result is read back as a table. State is bounded by the watermark: a window, a
session or a key goes when the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.tables import scratch

#: The time of the row that ends a stream: later than any other.
END = "9999-01-01 00:00:00"


def read(spark: SparkSession, path: str, by_name: bool = False, files: int | None = None) -> DataFrame:
    """A stream over one file, or a folder and those below it, with the schema of what is there. A file counts
    once by its path; with `by_name`, one whose name was read in an earlier batch does not count, wherever it lies.
    `files` is how many make a batch."""
    stream = spark.readStream.schema(spark.read.option("recursiveFileLookup", True).parquet(path).schema).option("fileNameOnly", by_name)
    stream = stream if files is None else stream.option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else stream.option("recursiveFileLookup", True).parquet(path)


def drain(stream: DataFrame, checkpoint: str | None = None, out: str | None = None, seen: list | None = None) -> DataFrame:
    """Run `stream` over all it has into Parquet; a second run with the same folders goes on where the
    first ended, as files and offsets done are in the checkpoint. The progress of each batch goes to `seen`."""
    spark = stream.sparkSession
    base = None if checkpoint and out else scratch(spark, "stream")
    checkpoint, out = checkpoint or f"{base}/checkpoint", out or f"{base}/out"
    run = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    if seen is not None:
        seen.extend(run.recentProgress)
    return spark.read.schema(stream.schema).parquet(out)


def late_rows(seen: list) -> int:
    """How many rows came after the watermark had passed them, by the batches' progress."""
    return sum(operator["numRowsDroppedByWatermark"] for batch in seen for operator in batch["stateOperators"])


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)


def to_the_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], time: str = "ts", seen: list | None = None) -> DataFrame:
    """What `build` makes of a stream that ends: after all files comes one row of nulls at END, whose watermark closes
    every window and session that is still open. `build` sets the watermark."""
    spark, base = stream.sparkSession, scratch(stream.sparkSession, "stream")
    end = spark.createDataFrame([(END,)], "t string").select(*[F.col("t").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
    end.where("false").write.parquet(f"{base}/end")
    whole = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{base}/end")))
    run = lambda: drain(whole, f"{base}/checkpoint", f"{base}/out", seen)
    run()
    end.coalesce(1).write.mode("append").parquet(f"{base}/end")
    return run()


def once(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows of each key once; keys are held as long as the watermark can meet them. Later rows are left out."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(keys).drop("_time")


def files_once(spark: SparkSession, path: str, keys: list[str], time: str = "ts", late: str = "1 hour", seen: list | None = None, files: int | None = None) -> DataFrame:
    """Rows of each file once, and of each key once within the watermark."""
    return drain(once(read(spark, path, files=files), keys, time, late), seen=seen)


def windows(stream: DataFrame, size: str, slide: str | None = None, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window (by `slide` apart, where given) and event type; rows later than `late` are left out."""
    grouped = timed(stream, time, late).groupBy(F.window("_time", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(stream: DataFrame, key: str, gap: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Start, end and size of each key's sessions: rows that follow one another within `gap`."""
    grouped = timed(stream, time, late).groupBy(key, F.session_window("_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("_time").alias("last"))
    return grouped.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), "n")


def tumbling(spark: SparkSession, path: str, size: str, slide: str | None = None) -> DataFrame:
    """All windows over all files."""
    return to_the_end(read(spark, path), lambda stream: windows(stream, size, slide))
