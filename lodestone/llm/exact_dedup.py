"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups.

Texts are equal when they agree after every run of ASCII white space became one space; a null text
counts as empty. Grouping keys are (md5, normalised text): the hash decides where rows meet and the
text itself, compared byte for byte, decides which are equal, so a hash collision cannot merge two
texts. Copies collapse in the map-side aggregation, so a hot group sends one row per map task; the
few groups that hold over a thousandth of the rows each are joined back by broadcast.

Defined cases: null ids sort last (a group with only null ids has keep_id null and keeps one row);
of rows that repeat both id and text one is kept; an empty table gives an empty result; other
columns are ignored by `decide` and carried through unchanged by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.skew import join_groups
from lodestone.tables import materialize

#: Runs of white space other than a single space, so that ordinary gaps cost no replacement.
GAPS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " ")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its hashes, smallest id and number of rows."""
    exact = rows.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    exact = exact.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n")
    # Rows find their group by both hashes; two different texts under one pair stop the job.
    return exact.groupBy("h", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")).select(
        "h", "sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share md5 and sha-256"))).alias("group_size"))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `df`."""
    rows = _digests(df, id_col, text_col)
    counted = rows.groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("copies"))
    # Both sides are digests alone, written once because each is read several times.
    joined = join_groups(materialize(counted, "digests"), materialize(_groups(rows), "groups"), ["h", "sha"], "group_size", df.count()).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, all columns unchanged: the one with the smallest id of each text. One
    aggregation by hash and text: texts move once, copies collapse before they do, and the text in the key
    compares the bytes. A row carries its own text only where that differs from the normalised one."""
    others = [c for c in df.columns if c != text_col]
    text = F.col("_text")
    rows = df.select(F.struct(*others).alias("_others"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_norm", normalised(text))
    own = F.struct("_others", F.when(text != F.col("_norm"), text).alias("text"), text.isNull().alias("none"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.xxhash64(F.to_json("_others"), "_text"))  # a hash takes no maps
    kept = rows.groupBy(F.unhex(F.md5("_norm")).alias("_h"), "_norm").agg(F.min_by(own, order).alias("_own"))
    whole = F.when(~F.col("_own.none"), F.coalesce("_own.text", "_norm"))
    return kept.select(*[whole.alias(c) if c == text_col else F.col("_own._others").getField(c).alias(c) for c in df.columns])


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
