"""Building training examples from questions, their supporting documents and answer trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_examples(steps: DataFrame, key: str, pos: str, step: str, ask: str, begin: str = "") -> DataFrame:
    """For each step, the text of all steps up to it and as label the next question, or that they are
    sufficient. One row per step; a question's steps are few, so the prefix is a window of its rows."""
    w = W.partitionBy(key).orderBy(pos)
    so_far = F.collect_list(step).over(w.rowsBetween(W.unboundedPreceding, 0))
    label = F.coalesce(F.concat(F.lit("[SUBQ] "), F.lead(ask).over(w)), F.lit("[SUFFICIENT]"))
    return steps.select(key, pos, F.concat(F.lit(begin), F.array_join(so_far, "\n")).alias("input"), label.alias("label"))


def complete_only(needs: DataFrame, have: DataFrame, key: str, on: str) -> DataFrame:
    """Keys all of whose needs(key, on) are in have(on)."""
    found = needs.join(have.select(on).distinct().withColumn("_found", F.lit(True)), on, "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("_found", F.lit(False))).alias("_all")).where("_all").select(key)


def pack(docs: DataFrame, key: str, score: str, tokens: str, budget: int, id_col: str) -> DataFrame:
    """Documents of a question in score order while their tokens fit; the first overflow ends it."""
    w = W.partitionBy(key).orderBy(F.desc(score), id_col).rowsBetween(W.unboundedPreceding, 0)
    return docs.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def select_docs(docs: DataFrame, key: str, pos: str, reply: str) -> DataFrame:
    """Documents that a model's reply names by their number in `pos` order, from 1: those of the first run of
    comma-separated numbers. A question without any number is dropped; one with a number out of range is kept
    as it is. `reply` is the same for all documents of a question, which are few, so a window numbers them."""
    own = W.partitionBy(key)
    numbers = F.regexp_extract(reply, r"(?:^|\D)(\d+(?:\s*,\s*\d+)*)", 1)
    numbered = docs.withColumns({"_i": F.row_number().over(own.orderBy(pos)), "_n": F.count(F.lit(1)).over(own), "_chosen": numbers}).where("_chosen <> ''")
    numbered = numbered.withColumn("_chosen", F.transform(F.split("_chosen", ","), lambda x: F.trim(x).cast("long")))
    odd = F.exists("_chosen", lambda x: (x < 1) | (x > F.col("_n")))
    return numbered.where(odd | F.array_contains("_chosen", F.col("_i").cast("long"))).drop("_i", "_n", "_chosen")


#: How question sets of public benchmarks name their fields. `top`: documents kept, all where it is None.
ADAPTERS = {
    "ranked": {"answer": "answers", "docs": "ctxs", "top": 5, "more": ["s_wiki_title", "prop"]},
    "claims": {"answer": "answers", "docs": "ctxs", "top": 5, "more": ["claim", "label"]},
    "all_docs": {"answer": "answer", "docs": "docs", "top": None, "more": []},
    "plain": {"answer": "answer", "docs": None, "top": None, "more": []},
}


def adapt(items: DataFrame, kind: str) -> DataFrame:
    """question, answer, context (texts of the documents) and the kind's own fields of a question set. Of kind
    "pairs" a document is an array of its title and its text, and the titles are the answers."""
    if kind == "pairs":
        return items.select("question", F.transform("context", lambda c: c[0]).alias("answer"), F.transform("context", lambda c: c[1]).alias("context"))
    spec = ADAPTERS[kind]
    texts = [] if spec["docs"] is None else [F.transform(spec["docs"] if spec["top"] is None else F.slice(spec["docs"], 1, spec["top"]), lambda c: c["text"]).alias("context")]
    return items.select("question", F.col(spec["answer"]).alias("answer"), *texts, *spec["more"])


def graph_prefixes(steps: DataFrame, key: str, pos: str, ask: str, found: str, instruction: str, done: DataFrame | None = None) -> DataFrame:
    """Planner examples of questions with several sub-queries: each step's input is the instruction and all
    sub-queries up to it with what was found for them; inputs in done(input) are left out, and equal inputs
    give one example, the first by key and position."""
    line = F.concat(F.lit("[SUBQ] "), F.col(ask), F.lit("\nRetrieved Graph Information: "), F.col(found))
    out = prefix_examples(steps.withColumn("_line", line), key, pos, "_line", ask, f"{instruction}\n")
    out = out.groupBy("input").agg(F.min(F.struct(key, pos, "label")).alias("_x")).select(f"_x.{key}", f"_x.{pos}", "input", "_x.label")
    return out if done is None else out.join(done.select("input").distinct(), "input", "left_anti")


def paragraphs_of(items: DataFrame, found: DataFrame, by: str | None, value: str) -> DataFrame:
    """items with what was retrieved for them: by id, or by row position (`pos` on both sides) without one."""
    key = by or "pos"
    return items.join(found.select(key, value), key)


def override(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Map merge: values of `over` replace those of `base`."""
    return base.select(key, F.col(value).alias("_a")).join(over.select(key, F.col(value).alias("_b")), key, "full").select(key, F.coalesce("_b", "_a").alias(value))
