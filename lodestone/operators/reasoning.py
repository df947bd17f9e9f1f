"""Question answering in several model calls: sub-queries document after document, and answers by candidates.

Prompts are functions of columns (or of strings, where a call needs the reply before it), models are the hooks of
`functions/models.py`. Every round of replies is written once, so that no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.functions.models import generate
from lodestone.tables import materialize


def sub_queries(docs: DataFrame, key: str, order: list[str], topic: str, hook: Callable[[list[str]], list[str]], prompt: Callable[[dict, list[str]], str], tries: int = 3) -> DataFrame:
    """docs with sub_query and is_fallback: a question for each document of a key, asked in `order` with the
    key's questions so far. A reply counts if it is a question of more than 10 characters; after `tries` others
    or errors the question is a stock one about the topic.

    A question needs the replies before it, so a key's documents go through one task in order; it streams them
    and holds the key's questions only. A null topic is empty; keys that are null are one key."""
    schema = T.StructType([*docs.schema.fields, T.StructField("sub_query", T.StringType()), T.StructField("is_fallback", T.BooleanType())])

    def ask(row: dict, before: list[str]) -> tuple[str, bool]:
        for _ in range(tries):
            try:
                reply = hook([prompt(row, before)])[0].strip().strip('"').strip()
            except Exception:
                continue
            if "?" in reply and len(reply) > 10:
                return reply, False
        return f"What does this document tell us about {row[topic] or ''}?", True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = object(), []
        for batch in batches:
            replies = []
            for row in batch.to_pylist():
                if row[key] != current:
                    current, before = row[key], []
                replies.append(ask(row, before))
                before.append(replies[-1][0])
            asked, stock = (pa.array([r[k] for r in replies], kind) for k, kind in ((0, pa.string()), (1, pa.bool_())))
            yield pa.RecordBatch.from_arrays([*batch.columns, asked, stock], names=schema.names)

    return docs.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def answer_by_candidates(items: DataFrame, key: str, question: str, passages: str, hook: Callable[[list[str]], list[str]], propose: Callable[[Column], Column],
                         summarise: Callable[[Column, Column, Column], Column], verify: Callable[[Column, Column], Column]) -> DataFrame:
    """key, candidates, summaries and output of each item: the model proposes candidates, sums up the passages for
    each of them, and chooses by the summaries; a choice that is not an object with final_answer is the first
    candidate. `key` is unique. All three rounds are distributed by row; a question's candidates meet again by
    key. An item without candidates has no summaries and a null output."""
    asked = generate(items.select(key, question, passages, propose(F.col(question)).alias("_prompt")), "_prompt", hook, "_reply")
    asked = materialize(asked.select(key, question, passages, tx.candidates(F.col("_reply")).alias("candidates")), "candidates")
    each = asked.select(key, F.posexplode("candidates").alias("_i", "_c"), question, passages)
    each = each.select(key, "_i", summarise(F.col(question), F.col("_c"), F.col(passages)).alias("_prompt"))
    found = materialize(generate(each, "_prompt", hook, "_summary").select(key, "_i", "_summary"), "summaries")
    found = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_summary"))), lambda s: s["_summary"]).alias("summaries"))
    whole = asked.join(found, key, "left").withColumn("summaries", F.coalesce("summaries", F.array().cast("array<string>")))
    block = F.array_join(F.zip_with("candidates", "summaries", lambda c, s: F.concat(F.lit("Candidate '"), c, F.lit("':\n"), F.coalesce(s, F.lit("")))), "\n\n")
    judged = generate(whole.withColumn("_prompt", verify(F.col(question), block)), "_prompt", hook, "_reply")
    output = F.coalesce(F.get_json_object("_reply", "$.final_answer"), F.get("candidates", F.lit(0)))
    return judged.select(key, "candidates", "summaries", output.alias("output"))
