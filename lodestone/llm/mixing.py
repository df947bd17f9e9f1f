"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget is propagated from the root: siblings share their parent's budget by weight, each up to
its capacity (its tokens times `max_epochs`). What a child cannot use goes to its siblings first; only
what all of them cannot use stays with the ancestors, whose siblings then share it. A leaf with budget
b over t tokens takes every document floor(b / t) times and, of the next epoch's seeded order, the
token-prefix that fits the rest. The prefix's end is found digit pair by digit pair of the places in the
order: each step sums at most 256 bins of a leaf, and only the last bin of a few rows is sorted. It is kept
as one cut per leaf: no leaf is collected anywhere, and a leaf of most rows costs a task no more than others.

Defined cases: a weight of 0 or less leaves all below it out, and its siblings share the whole budget;
null domain, language or source is the empty name; a text counts as
max(1, ceil(bytes / 4)) tokens; rows that repeat an id stand at one place of the order and are taken
together; null ids order like the id "null"; an empty table gives an empty result. `decide` ignores
other columns, `select` keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.skew import join_groups
from lodestone.tables import materialize

LEVELS = ("domain", "lang", "source")
#: Rows of the bin of a leaf's order that is sorted, about.
BIN_ROWS = 64
#: Leaves whose table is broadcast; more meet their rows by shuffles, the hot ones still by broadcast.
FEW_LEAVES = 100_000


def domain_of(source: Column, n: int = 4) -> Column:
    """The domain of a source: its number modulo `n`."""
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, r"(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("long") % n, F.lit(0)).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    known = weights.get(level, {})
    # What weighs nothing has no capacity and so no budget, whatever it is divided by.
    known = {name: weight if weight > 0 else 1.0 for name, weight in known.items()}
    return reduce(lambda case, kv: case.when(F.col(level) == kv[0], float(kv[1])), known.items(), F).otherwise(1.0) if known else F.lit(1.0)


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent, capacity, weight, budget of the parent as `given`) -> with `budget`."""
    family, order = W.partitionBy(*parent), W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"))
    nodes = nodes.withColumn("used", F.sum("capacity").over(order)).withColumn("rest", F.sum("weight").over(family) - F.sum("weight").over(order))
    nodes = nodes.withColumn("full", F.col("used") + F.col("capacity") / F.col("weight") * F.col("rest") <= F.col("given"))
    level = (F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(family)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(family)
    return nodes.withColumn("level", F.when(~F.col("full"), level)).withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.round(F.col("level") * F.col("weight"), 3))).drop("used", "rest", "full", "level", "given")


def budgets(rows: DataFrame, weights: dict[str, dict[str, float]], fraction: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, n (rows), budget of every leaf of rows(domain, lang, source, tokens)."""
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    out = [(level, [name for name, weight in weights.get(level, {}).items() if weight <= 0]) for level in LEVELS]
    usable = reduce(lambda case, x: case.when(F.col(x[0]).isin(x[1]), 0) if x[1] else case, out, F.when(F.lit(False), 0)).otherwise(F.col("tokens"))
    capacity = lambda *by: leaves.groupBy(*by).agg((F.sum(usable) * max_epochs).cast("double").alias("capacity"))
    root = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * fraction).cast("double")).first()[0]
    given = capacity("domain").withColumn("root", F.lit(0)).withColumn("weight", _weight("domain", weights)).withColumn("given", F.lit(root))
    given = _share(given, ["root"]).select("domain", F.col("budget").alias("given"))
    given = _share(capacity("domain", "lang").withColumn("weight", _weight("lang", weights)).join(given, "domain"), ["domain"]).select("domain", "lang", F.col("budget").alias("given"))
    shared = _share(capacity(*LEVELS).withColumn("weight", _weight("source", weights)).join(given, ["domain", "lang"]), ["domain", "lang"])
    return leaves.join(shared.select(*LEVELS, F.floor("budget").cast("long").alias("budget")), list(LEVELS))


def _rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None) -> DataFrame:
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"), name(domain_of(F.col(source_col)) if domain is None else domain).alias("domain"), name(F.col(lang_col)).alias("lang"), name(F.col(source_col)).alias("source"),
        F.greatest(F.lit(1), F.expr(f"(coalesce(octet_length(`{text_col}`), 0) + 3) div 4")).cast("long").alias("tokens"))


def _place(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _meet(rows: DataFrame, leaves: DataFrame, n_leaves: int, total: int) -> DataFrame:
    """rows joined with leaves(domain, lang, source, n, ..)."""
    return rows.join(F.broadcast(leaves), list(LEVELS)) if n_leaves <= FEW_LEAVES else join_groups(rows, leaves, list(LEVELS), "n", total)


def cuts(rows: DataFrame, weights: dict[str, dict[str, float]], fraction: float, max_epochs: int, seed: int) -> tuple[DataFrame, int, int]:
    """Per leaf: n, budget, whole epochs, and the last place of the next epoch that is taken; the numbers of leaves and rows."""
    leaves = materialize(budgets(rows, weights, fraction, max_epochs).withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    n_leaves, total, most = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = _meet(rows, leaves.drop("tokens", "budget"), n_leaves, total).select(*LEVELS, "tokens", _place(F.col("doc_id"), F.col("epochs"), seed).alias("place"))
    placed = materialize(placed, "placed")
    at, digits = leaves.select(*LEVELS, "n", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before")), 0
    inside = lambda: _meet(placed, at, n_leaves, total).where(F.startswith("place", "prefix"))
    while True:
        digits += 2
        sums = inside().groupBy(*LEVELS, "n", "rest", "before", F.substring("place", 1, digits).alias("bin")).agg(F.sum("tokens").alias("own"))
        sums = sums.withColumn("start", F.col("before") + F.sum("own").over(W.partitionBy(*LEVELS).orderBy("bin")) - F.col("own"))
        at = materialize(sums.where("start <= rest AND rest < start + own").select(*LEVELS, "n", "rest", F.col("bin").alias("prefix"), F.col("start").alias("before")), "bins")
        if 16**digits * BIN_ROWS >= most:
            break
    # Rows that share a place, as those without id do, are one row here.
    last = inside().groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("tokens").alias("own"))
    last = last.withColumn("upto", F.col("before") + F.sum("own").over(W.partitionBy(*LEVELS).orderBy("place")))
    ends = last.where("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("end"))
    found = leaves.join(at.select(*LEVELS, "prefix"), list(LEVELS), "left").join(ends, list(LEVELS), "left")
    return materialize(found.select(*LEVELS, "n", "budget", "epochs", F.coalesce("end", "prefix").alias("cut")), "cuts"), n_leaves, total


def decide(df: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.5, max_epochs: int = 2, seed: int = 42, domain: Column | None = None,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, domain, lang, source, tokens, budget (of the leaf) and copies for every row of `df`."""
    rows = materialize(_rows(df, id_col, text_col, lang_col, source_col, domain), "sizes")
    taken = _meet(rows, *cuts(rows, weights, fraction, max_epochs, seed))
    copies = F.col("epochs") + F.coalesce(_place(F.col("doc_id"), F.col("epochs"), seed) <= F.col("cut"), F.lit(False)).cast("long")
    return taken.select("doc_id", *LEVELS, "tokens", "budget", copies.alias("copies"))


def select(df: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.5, max_epochs: int = 1, seed: int = 42, domain: Column | None = None,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `df`, each as often as the mix takes it."""
    limits, n_leaves, _ = cuts(materialize(_rows(df, id_col, text_col, lang_col, source_col, domain), "sizes"), weights, fraction, max_epochs, seed)
    limits = F.broadcast(limits) if n_leaves <= FEW_LEAVES else limits
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = zip(LEVELS, (domain_of(F.col(source_col)) if domain is None else domain, F.col(lang_col), F.col(source_col)))
    # The input's row is one value until the end, so its columns meet none of these names.
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_id"), *[name(c).alias(k) for k, c in keys])
    taken = rows.join(limits.select(*LEVELS, "epochs", "cut"), list(LEVELS))
    copies = F.col("epochs") + F.coalesce(_place(F.col("_id"), F.col("epochs"), seed) <= F.col("cut"), F.lit(False)).cast("long")
    taken = taken.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


#: The weights and budget of the query.
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 2.0, "domain2": 1.0}, "lang": {"en": 4.0, "de": 2.0}}

ORACLE = r"""
WITH r AS (SELECT doc_id, 'domain' || coalesce(try_cast(nullif(regexp_extract(source, '(\d{1,9})', 1), '') AS BIGINT) % 4, 0) AS domain,
                  coalesce(lang, '') AS lang, coalesce(source, '') AS source, greatest(1, (coalesce(octet_length(encode(text)), 0) + 3) // 4)::BIGINT AS tokens FROM documents),
l AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
d1 AS (SELECT domain, sum(tokens)::DOUBLE * 2 AS capacity, CASE domain WHEN 'domain0' THEN 4.0::DOUBLE WHEN 'domain1' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (SELECT sum(tokens)::DOUBLE * 0.5::DOUBLE FROM l) AS given FROM l GROUP BY domain),
d2 AS (SELECT *, sum(capacity) OVER o + capacity / weight * (sum(weight) OVER () - sum(weight) OVER o) <= given AS f FROM d1 WINDOW o AS (ORDER BY capacity / weight)),
d3 AS (SELECT domain, CASE WHEN f THEN capacity ELSE round((given - sum(CASE WHEN f THEN capacity ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN f THEN 0 ELSE weight END) OVER (), 0) * weight, 3) END AS given FROM d2),
e1 AS (SELECT domain, lang, sum(tokens)::DOUBLE * 2 AS capacity, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, any_value(given) AS given FROM l JOIN d3 USING (domain) GROUP BY domain, lang),
e2 AS (SELECT *, sum(capacity) OVER o + capacity / weight * (sum(weight) OVER p - sum(weight) OVER o) <= given AS f FROM e1 WINDOW p AS (PARTITION BY domain), o AS (PARTITION BY domain ORDER BY capacity / weight)),
e3 AS (SELECT domain, lang, CASE WHEN f THEN capacity ELSE round((given - sum(CASE WHEN f THEN capacity ELSE 0 END) OVER p) / nullif(sum(CASE WHEN f THEN 0 ELSE weight END) OVER p, 0) * weight, 3) END AS given FROM e2 WINDOW p AS (PARTITION BY domain)),
s1 AS (SELECT domain, lang, source, tokens, tokens::DOUBLE * 2 AS capacity, 1.0::DOUBLE AS weight, given FROM l JOIN e3 USING (domain, lang)),
s2 AS (SELECT *, sum(capacity) OVER o + capacity / weight * (sum(weight) OVER p - sum(weight) OVER o) <= given AS f FROM s1 WINDOW p AS (PARTITION BY domain, lang), o AS (PARTITION BY domain, lang ORDER BY capacity / weight)),
s3 AS (SELECT domain, lang, source, tokens AS total, floor(CASE WHEN f THEN capacity ELSE round((given - sum(CASE WHEN f THEN capacity ELSE 0 END) OVER p) / nullif(sum(CASE WHEN f THEN 0 ELSE weight END) OVER p, 0) * weight, 3) END)::BIGINT AS budget FROM s2 WINDOW p AS (PARTITION BY domain, lang)),
x AS (SELECT r.*, budget, budget // total AS epochs, budget - budget // total * total AS rest, md5('42:' || (budget // total) || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM r JOIN s3 USING (domain, lang, source)),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM x)
SELECT doc_id, domain, lang, source, tokens, budget, (epochs + (upto <= rest)::INT)::BIGINT AS copies FROM y
"""
