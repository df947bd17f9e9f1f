"""The numbered operators as queries over whole tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, exact_dedup, hard_negatives, licenses, line_rules, mixing, near_dedup, periods, quality_lm, sharding, token_counts, warc
from lodestone.tables import materialize, scratch, table

VOCABULARY = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    # Written in between, so that an executor does not hold the workers of both directions at once.
    encoded = materialize(bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"]), "ids")
    return bpe.digests(bpe.decode(encoded, path))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(conversations.unionByName(probe)))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return judged.select("doc_id", "lang", "n_scored", "log_perplexity", "threshold", F.col("good").alias("kept"))


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periods.made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periods.digests(periods.find(texts, keep=["doc_id"]))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=relabelled)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_chat_format, op3_warc_bundles, op4_exact_dedup, op5_quality_lm, op6_hierarchical_mix, op7_minhash_near_dedup, op8_hash_tree_shards, op9_license_scan, op10_line_rules, op11_periodic_runs, op12_token_counts, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op2_chat_format": chat.ORACLE, "op3_warc_bundles": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op6_hierarchical_mix": mixing.ORACLE, "op10_line_rules": line_rules.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
