"""Scores of answers against several gold answers, and the spread of their means.

A metric takes the prediction and the array of gold answers as columns and gives a double; `over_golds` lifts one
that takes a single gold answer. All metrics of a table are computed in one pass over it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

Metric = Callable[[Column, Column], Column]

#: The field of the key's hash, and the Poisson counts of mean 1 that can be told apart in it.
PRIME, COUNTS = 2**31 - 1, 11


def over_golds(one: Metric) -> Metric:
    """The greatest value of a metric of one gold answer; null without gold answers."""
    return lambda prediction, golds: F.array_max(F.transform(golds, lambda g: one(prediction, g)))


def rouge_1(prediction: Column, golds: Column) -> Column:
    """ROUGE-1 F-measure without stemming, against the best gold answer."""
    return tx.best_overlap(prediction, golds, lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)))


METRICS: dict[str, Metric] = {
    "em": lambda p, golds: tx.bind(tx.normalize_answer(p), lambda n: over_golds(lambda n, g: (n == tx.normalize_answer(g)).cast("double"))(n, golds)),
    "f1": tx.best_f1,
    "match": lambda p, golds: tx.matches(p, golds).cast("double"),
    "contains": over_golds(lambda p, g: F.contains(F.lower(p), F.lower(g)).cast("double")),
    "rouge1": rouge_1}


def scored(df: DataFrame, prediction: str, golds: str, metrics: Mapping[str, Metric] | list[str]) -> DataFrame:
    """`df` with a column for each metric, given by name or as name and function."""
    chosen = {m: METRICS[m] for m in metrics} if isinstance(metrics, list) else dict(metrics)
    return df.withColumns({name: f(F.col(prediction), F.col(golds)) for name, f in chosen.items()})


def by_task(df: DataFrame, prediction: str, golds: str, task: str, choice: Mapping[str, Metric | str], name: str = "score") -> DataFrame:
    """`df` with the score by the metric of each row's task; null for other tasks. A row computes its own metric only."""
    value = lambda m: (METRICS[m] if isinstance(m, str) else m)(F.col(prediction), F.col(golds))
    return df.withColumn(name, reduce(lambda case, kv: case.when(F.col(task) == kv[0], value(kv[1])), choice.items(), F))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def poisson_steps() -> list[int]:
    """A uniform number below PRIME stands for the count of these that it reaches: Poisson of mean 1."""
    share = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(COUNTS)]
    return [math.floor(PRIME * s) for s in share]


def bootstrap(df: DataFrame, key: Column, metrics: list[str], by: list[str], replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """by, metric, n, mean, low, mid, high: of each metric column its mean, and the limits and the middle of the means of
    resampled tables. Every row has a Poisson weight in each replicate: a linear function, drawn from the seed and the
    replicate's number, of the hash of its key, so weights depend on no order or partitioning. One aggregation with
    map-side sums gives all replicates, so a task sends a row a group and replicate.

    Rows with a null metric do not count for it; equal keys share their weights, a null key is the key "null";
    a replicate without weight does not count."""
    x = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % PRIME
    draws = [F.struct(F.lit(b).alias("_b"), F.lit(_number(f"{seed}:a:{b}") % (PRIME - 1) + 1).cast("long").alias("_a"), F.lit(_number(f"{seed}:c:{b}") % PRIME).cast("long").alias("_c")) for b in range(1, replicates + 1)]
    # Replicate 0 is the table as it is.
    every = F.array(F.struct(F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_c")), *draws)
    rows = df.select(*by, *metrics, x.alias("_x")).select(*by, *metrics, "_x", F.inline(every))
    u = (F.col("_a") * F.col("_x") + F.col("_c")) % PRIME
    rows = rows.withColumn("_u", u)
    weight = reduce(lambda a, b: a + b, [(F.col("_u") >= step).cast("int") for step in poisson_steps()])
    rows = rows.withColumn("_w", F.when(F.col("_b") == 0, 1).otherwise(weight))
    sums = rows.groupBy(*by, "_b").agg(*[f(F.when(F.col(m).isNotNull(), F.col("_w") * v)).alias(f"{p}_{m}") for m in metrics for p, f, v in (("_n", F.sum, F.lit(1)), ("_s", F.sum, F.col(m).cast("double")))])
    long = sums.select(*by, "_b", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_n_{m}").alias("n"), F.col(f"_s_{m}").alias("s")) for m in metrics])).alias("_m")).select(*by, "_b", "_m.*")
    mean = F.col("s") / F.nullif("n", F.lit(0))
    edge = (1 - confidence) / 2
    spread = F.percentile(F.when(F.col("_b") > 0, mean), F.array(F.lit(edge), F.lit(0.5), F.lit(1 - edge)))
    whole = lambda c: F.max(F.when(F.col("_b") == 0, c))
    out = long.groupBy(*by, "metric").agg(whole(F.col("n")).alias("n"), whole(mean).alias("mean"), spread.alias("q"))
    return out.select(*by, "metric", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "mid", "high"))])
