"""Aligning, merging and splitting corpora whose join key is the text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_map(new: DataFrame, old: DataFrame, text: str = "text") -> DataFrame:
    """old_idx -> new_idx of equal texts; of repeated new texts the last index counts."""
    return text_map(old, new, "idx", text).select(F.col("left_id").alias("old_idx"), F.col("right_id").alias("new_idx"))


def keyed(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """`columns` of the rows that have a text, with _k1 and _k2: two hashes of 64 bits that stand for the text, so that no
    text is shuffled."""
    return df.where(F.col(text).isNotNull()).select(*columns, F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2"))


def text_map(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """left_id -> right_id of equal texts, one row per left row: of repeated right texts the last id counts."""
    last = keyed(right, text, id_col).groupBy("_k1", "_k2").agg(F.max(id_col).alias("right_id"))
    return keyed(left, text, id_col).withColumnRenamed(id_col, "left_id").join(last, ["_k1", "_k2"]).select("left_id", "right_id")


def text_join(left: DataFrame, right: DataFrame, text: str, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """left_columns and right_columns of all pairs of rows with equal texts."""
    return keyed(left, text, *left_columns).join(keyed(right, text, *right_columns), ["_k1", "_k2"]).select(*left_columns, *right_columns)


def gather(new: DataFrame, old: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Every row of `new` with its old vector, or the zero vector."""
    return new.join(old.select(key, vector), key, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim)))


def dedup_replicate(values: DataFrame, corpus: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Each occurrence in `corpus` of a text that has a value, with the first value (by `order`) of its text."""
    first = keyed(values, key, value, *order).groupBy("_k1", "_k2").agg(F.min_by(value, F.struct(*order)).alias(value))
    return keyed(corpus, key, *corpus.columns).join(first, ["_k1", "_k2"]).drop("_k1", "_k2")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Old and new values by key; the new one wins."""
    return old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full").select(key, F.coalesce("_new", "_old").alias(value))


def missing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done: resuming by key, not by count."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])).alias("_x")).select(key, "_x.*")
