"""The training-data pipeline: five operators, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Stage by stage the result is written to the shared folder and read again; what came before is deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, mixing, near_dedup, quality_lm
from lodestone.tables import discard, intermediates, materialize, scratch, ship, table

#: Share of the tokens that reach the mix and leave it; no document is taken twice.
MIX_FRACTION = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    return quality_lm.classify(rows, table(spark, sf_dir, "labels"), keep=["row"]).where("good").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards their target weights."""
    return mixing.select(docs, mixing.WEIGHTS, fraction=MIX_FRACTION, max_epochs=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, proved by decoding them again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.decode(materialize(bpe.encode(docs, path, keep=["doc_id"]), "ids"), path))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mix_sources", mix), ("bpe", tokens)]

#: The n-gram model and the sketches have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's own tables go when its result is written, and that goes when the next one's is."""
    ship(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with intermediates(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
