"""Statistics and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import rouge, schedule
from lodestone.functions import text as tx
from lodestone.operators import evaluation, intervals, ranks, rows
from lodestone.plans.registry import query
from lodestone.plans.texts import f1_sql, norm_sql, overlap_sql
from lodestone.tables import scratch, table


@query("""WITH x AS (SELECT length(text) AS n FROM documents) SELECT round(avg(n), 4) AS mean, max(n)::BIGINT AS most, min(n)::BIGINT AS least, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99 FROM x""")
def length_percentiles(spark, d):
    n = F.length("text")
    q = F.percentile(n, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    s = table(spark, d, "documents").agg(F.round(F.avg(n), 4).alias("mean"), F.max(n).cast("long").alias("most"), F.min(n).cast("long").alias("least"), q.alias("q"))
    return s.select("mean", "most", "least", *[F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(("p50", "p90", "p95", "p99"))])


@query("""WITH b AS (SELECT * FROM (VALUES (0, 0, 512), (1, 512, 1024), (2, 1024, 2048), (3, 2048, 3072), (4, 3072, 1000000000)) AS t(bin, lo, hi)), x AS (SELECT length(text) AS n FROM documents)
SELECT bin, count(n) AS n, round(100.0::DOUBLE * count(n) / (SELECT count(*) FROM x), 4) AS percent FROM b LEFT JOIN x ON n >= lo AND n < hi GROUP BY bin""")
def length_histogram(spark, d):
    n = F.length("text")
    bin_ = F.when(n < 512, 0).when(n < 1024, 1).when(n < 2048, 2).when(n < 3072, 3).otherwise(4)
    counts = table(spark, d, "documents").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(5).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return every.join(F.broadcast(total), F.col("n") <= F.col("total")).select("bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS positive, round(100.0::DOUBLE * count(*) FILTER (quality = 1) / count(*), 4) AS percent FROM labels")
def label_summary(spark, d):
    yes = F.count_if(F.col("quality") == 1)
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), yes.alias("positive"), F.round(100.0 * yes / F.count(F.lit(1)), 4).alias("percent"))


@query("""WITH x AS (SELECT quality AS t, (n_chars > 200)::INT AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM x)
SELECT round(tp::DOUBLE / (tp + fp), 6) AS precision_, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def micro_f1(spark, d):
    t, p = F.col("quality"), (F.col("n_chars") > 200).cast("int")
    c = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"))
    safe = lambda a, b: F.coalesce(F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), 6), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(safe(tp, tp + fp).alias("precision_"), safe(tp, tp + fn).alias("recall"), safe(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def _pairs(spark, d):
    """Neighbouring turns as prediction and gold."""
    c = table(spark, d, "conversations")
    gold = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.join(gold, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("p"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The "), "text", F.lit("!"))).otherwise(F.col("gold")).alias("g"))


PAIRS = "(SELECT a.conv_id, a.turn, a.text AS p, CASE WHEN a.turn % 3 = 0 THEN 'The ' || a.text || '!' ELSE b.text END AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
SAME = f"({norm_sql('p')} = {norm_sql('g')})"


@query(f"SELECT conv_id, count(*) AS n, round(avg({SAME}::INT), 6) AS em FROM {PAIRS} GROUP BY conv_id")
def exact_match(spark, d):
    same = (tx.normalize_answer(F.col("p")) == tx.normalize_answer(F.col("g"))).cast("int")
    return _pairs(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("em"))


@query(f"SELECT round(100.0::DOUBLE * avg({SAME}::INT), 6) AS accuracy FROM {PAIRS}")
def accuracy(spark, d):
    golds = F.array("g")
    same = (tx.normalize_answer(F.col("p")) == tx.normalize_answer(F.get(golds, F.lit(0)))).cast("int")
    return _pairs(spark, d).agg(F.round(100.0 * F.avg(same), 6).alias("accuracy"))


@query(f"SELECT count(*) AS n, round(100.0::DOUBLE * avg((p = CASE WHEN conv_id % 4 = 0 THEN p WHEN conv_id % 4 = 1 THEN upper(p) ELSE g END)::INT), 6) AS accuracy FROM {PAIRS}")
def raw_accuracy(spark, d):
    """Equal to the first gold as it stands, without normalisation."""
    k = F.col("conv_id") % 4
    golds = F.array(F.when(k == 0, F.col("p")).when(k == 1, F.upper("p")).otherwise(F.col("g")), F.col("p"))
    same = (F.col("p") == F.get(golds, F.lit(0))).cast("int")
    return _pairs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(same), 6).alias("accuracy"))


@query(f"SELECT count(*) AS n, round(avg({SAME}::INT), 6) AS em, round(avg({f1_sql('p', 'g')}), 6) AS f1, round(avg(contains({norm_sql('p')}, {norm_sql('g')})::INT), 6) AS match FROM {PAIRS}")
def pip_qa_eval(spark, d):
    p, g = F.col("p"), F.col("g")
    return _pairs(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((tx.normalize_answer(p) == tx.normalize_answer(g)).cast("int")), 6).alias("em"),
        F.round(F.avg(tx.token_f1(p, g)), 6).alias("f1"), F.round(F.avg(tx.matches(p, F.array(g))), 6).alias("match"))


@query(f"""WITH x AS (SELECT regexp_replace(array_to_string(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')[1:100], ' '), '[!-/:-@\\[-`{{-~]+$', '') AS p, g FROM {PAIRS})
SELECT count(*) AS n, round(avg(contains({norm_sql('p')}, {norm_sql('g')})::INT), 6) AS match FROM x WHERE NOT contains(lower(p), 'apolo') AND NOT contains(lower(p), 'the information')""")
def pip_eval(spark, d):
    x = _pairs(spark, d).select(tx.first_tokens(F.col("p")).alias("p"), "g")
    x = x.where(~F.contains(F.lower("p"), F.lit("apolo")) & ~F.contains(F.lower("p"), F.lit("the information")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tx.matches(F.col("p"), F.array("g"))), 6).alias("match"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean_100 FROM events")
def moving_avg_100(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 9).alias("mean_100"))


@query("WITH x AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, event_id, least(value, before) AS best, before IS NULL OR value < before AS improved FROM x")
def running_best(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    x = table(spark, d, "events").select("user_id", "event_id", "value", F.min("value").over(w).alias("before"))
    return x.select("user_id", "event_id", F.least("value", "before").alias("best"), (F.col("before").isNull() | (F.col("value") < F.col("before"))).alias("improved"))


@query("""WITH t AS (SELECT round(avg(value) FILTER (event_type = 'click'), 4) AS d, round(stddev_pop(value) FILTER (event_type = 'click'), 4) AS ds, round(avg(value) FILTER (event_type = 'view'), 4) AS s, round(stddev_pop(value) FILTER (event_type = 'view'), 4) AS ss FROM events)
SELECT d AS dense_mean, ds AS dense_std, s AS scoped_mean, ss AS scoped_std, round((d - s) / d * 100, 2) AS percent_saved, round(s / 10 * 1000, 2) AS ms_per_query FROM t""")
def timing_summary(spark, d):
    on = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    t = table(spark, d, "events").agg(*[F.round(f(on(k)), 4).alias(n) for k, n, f in (("click", "dense_mean", F.avg), ("click", "dense_std", F.stddev_pop), ("view", "scoped_mean", F.avg), ("view", "scoped_std", F.stddev_pop))])
    return t.select("*", F.round((F.col("dense_mean") - F.col("scoped_mean")) / F.col("dense_mean") * 100, 2).alias("percent_saved"), F.round(F.col("scoped_mean") / 10 * 1000, 2).alias("ms_per_query"))


@query("""WITH b AS (SELECT event_id // 32 AS step, sum(value) AS loss FROM events GROUP BY event_id // 32), n AS (SELECT max(step) + 1 AS total, (max(step) + 1) // 10 AS warm FROM b)
SELECT step, round(loss, 2) AS loss, round(CASE WHEN step < warm THEN step / greatest(warm, 1)::DOUBLE ELSE greatest(0, 0.5::DOUBLE * (1 + cos(pi() * (step - warm) / greatest(total - warm, 1)::DOUBLE))) END, 9) AS factor FROM b, n""")
def cosine_schedule(spark, d):
    """The learning rate's factor at each batch of a training log: a tenth of the batches to warm up, then half a cosine."""
    log = table(spark, d, "events").groupBy(F.expr("event_id div 32").alias("step")).agg(F.sum("value").alias("loss"))
    total = (log.agg(F.max("step")).first()[0] or 0) + 1
    return log.select("step", F.round("loss", 2).alias("loss"), F.round(schedule.cosine(F.col("step"), total // 10, total), 9).alias("factor"))


@query("WITH b AS (SELECT event_id // 32 AS batch, avg(value) AS loss, count(*) AS n FROM events GROUP BY event_id // 32) SELECT round(avg(loss), 4) AS loss, count(*) AS batches FROM b WHERE n = 32")
def full_batches_only(spark, d):
    b = table(spark, d, "events").groupBy(F.expr("event_id div 32").alias("batch")).agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n"))
    return b.where("n = 32").agg(F.round(F.avg("loss"), 4).alias("loss"), F.count(F.lit(1)).alias("batches"))


@query(None)
def rouge_lsum(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(rouge.rouge_lsum(F.col("p"), F.col("g")), 6).alias("rouge"))


def _with_golds(spark, d):
    """Each prediction with two gold answers: the neighbouring turn's, and a sentence of its own in other words."""
    return _pairs(spark, d).withColumn("golds", F.array("g", F.concat(F.lit("An "), F.reverse(F.split("p", " "))[0], F.lit(" of "), "g")))


@query(None)
def rouge_stemmed(spark, d):
    """All kinds with stemming, by the better of two gold answers."""
    x = _with_golds(spark, d).select("conv_id", "turn", rouge.rouge(F.col("p"), F.col("golds")).alias("r"))
    return x.select("conv_id", "turn", *[F.round(F.col("r")[k], 6).alias(k.lower()) for k in rouge.KINDS])


@query(None)
def bootstrap_rouge(spark, d):
    """The mean of stemmed ROUGE and its spread, by task."""
    x = _with_golds(spark, d).withColumn("r", rouge.rouge(F.col("p"), F.col("golds")))
    x = x.select("conv_id", "turn", F.expr("conv_id % 3").alias("task"), *[F.col("r")[k].alias(k.lower()) for k in rouge.KINDS])
    return evaluation.bootstrap(x, F.concat_ws(":", "conv_id", "turn"), [k.lower() for k in rouge.KINDS], ["task"], 200)


WITH_GOLDS = f"(SELECT *, [g, 'An ' || string_split(p, ' ')[-1] || ' of ' || g] AS golds FROM {PAIRS})"
METRICS = list(evaluation.METRICS)
#: Every metric by the best gold answer; texts are normalised and split once a pair.
SCORED = f"""(SELECT conv_id, turn, max((np = nq)::INT::DOUBLE) AS em, max({overlap_sql('pw', 'qw')}) AS f1, max(contains(np, nq)::INT::DOUBLE) AS match, max(contains(lower(p), lower(q))::INT::DOUBLE) AS contains, max({overlap_sql('p1', 'q1')}) AS rouge1
FROM (SELECT *, list_filter(string_split(np, ' '), lambda w: w <> '') AS pw, list_filter(string_split(nq, ' '), lambda w: w <> '') AS qw, regexp_extract_all(lower(p), '[a-z0-9]+') AS p1, regexp_extract_all(lower(q), '[a-z0-9]+') AS q1
 FROM (SELECT conv_id, turn, p, q, {norm_sql('p')} AS np, {norm_sql('q')} AS nq FROM (SELECT conv_id, turn, p, unnest(golds) AS q FROM {WITH_GOLDS}))) GROUP BY conv_id, turn)"""


@query("SELECT conv_id, turn, " + ", ".join(f"round({m}, 9) AS {m}" for m in METRICS) + f" FROM {SCORED}")
def metrics_over_golds(spark, d):
    """Every metric of the registry over the gold answers, in one pass."""
    x = evaluation.scored(_with_golds(spark, d), "p", "golds", METRICS)
    return x.select("conv_id", "turn", *[F.round(m, 9).alias(m) for m in METRICS])


TASKS = {"0": "em", "1": "f1", "2": "match", "3": "rouge1"}


@query("SELECT task, count(*) AS n, round(avg(score), 6) AS score FROM (SELECT (conv_id % 5)::VARCHAR AS task, CASE (conv_id % 5)::VARCHAR " + " ".join(f"WHEN '{t}' THEN {m}" for t, m in TASKS.items()) + f" END AS score FROM {SCORED}) GROUP BY task")
def metric_by_task(spark, d):
    """Each task by its own metric; the last task has none."""
    x = evaluation.by_task(_with_golds(spark, d).withColumn("task", (F.col("conv_id") % 5).cast("string")), "p", "golds", "task", TASKS)
    return x.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


BOOTSTRAP = f"""WITH d AS (SELECT b, ('0x' || substr(md5('42:a:' || b), 1, 8))::BIGINT % {evaluation.PRIME - 1} + 1 AS a, ('0x' || substr(md5('42:c:' || b), 1, 8))::BIGINT % {evaluation.PRIME} AS c FROM range(1, 201) t(b)),
s AS (SELECT conv_id % 3 AS task, ('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::BIGINT % {evaluation.PRIME} AS x, f1, rouge1 FROM {SCORED}),
w AS (SELECT task, b, f1, rouge1, len(list_filter({evaluation.poisson_steps()}, lambda t: (a * x + c) % {evaluation.PRIME} >= t)) AS w FROM s, d),
r AS (SELECT task, b, unnest(['f1', 'rouge1']) AS metric, unnest([sum(w * f1), sum(w * rouge1)]) / sum(w) AS m FROM w GROUP BY task, b),
p AS (SELECT task, unnest(['f1', 'rouge1']) AS metric, unnest([count(*), count(*)]) AS n, unnest([avg(f1), avg(rouge1)]) AS mean FROM s GROUP BY task)
SELECT task, metric, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM r JOIN p USING (task, metric) GROUP BY task, metric"""


@query(BOOTSTRAP)
def bootstrap_scores(spark, d):
    """The means of F1 and ROUGE-1 and their spread over 200 resampled tables, by task."""
    x = evaluation.scored(_with_golds(spark, d).withColumn("task", F.col("conv_id") % 3), "p", "golds", ["f1", "rouge1"])
    out = evaluation.bootstrap(x, F.concat_ws(":", "conv_id", "turn"), ["f1", "rouge1"], ["task"], 200)
    return out.select("task", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "mid", "high")])


# Engine extras: grouping sets, range frames, as-of and range joins.

@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_pricing(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube_sources(spark, d):
    return table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT e.event_id, coalesce(p.event_id, -1) AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""")
def asof_last_purchase(spark, d):
    from lodestone.operators.asof import asof

    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return asof(e.where("event_type = 'click'").drop("event_type"), right, "user_id", "ts", "last_purchase").select("event_id", F.coalesce("last_purchase", F.lit(-1)).alias("last_purchase"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY n_name""")
def star_join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    x = x.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


MICROS = "epoch_us(ts)"


def _timed_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {MICROS} AS at, (value * 60000000)::BIGINT AS span FROM events)
SELECT l.event_id AS purchase_id, r.event_id AS view_id FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'view' AND l.at <= r.at + 600000000 AND r.at - 600000000 <= l.at + l.span""")
def overlapping_intervals(spark, d):
    """Purchases that last as many minutes as their value, with the views of the same user ten minutes around."""
    e, ten = _timed_events(spark, d), 600_000_000
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("start"), (F.col("at") + (F.round(F.col("value") * 60_000_000)).cast("long")).alias("end"))
    right = e.where("event_type = 'view'").select("event_id", "user_id", (F.col("at") - ten).alias("start"), (F.col("at") + ten).alias("end"))
    return intervals.flat(intervals.overlap_join(left, right, ["user_id"]), {"purchase_id": "event_id"}, {"view_id": "event_id"})


@query(f"SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'error' AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000")
def errors_within_a_minute(spark, d):
    """Pairs of errors of any users a minute apart at most: a join on time alone."""
    e = _timed_events(spark, d).where("event_type = 'error'").select("event_id", "at")
    pairs = intervals.flat(intervals.within(e, e, 60_000_000, "at", []), {"event_id": "event_id"}, {"other_id": "event_id"})
    return pairs.where("event_id < other_id")


@query("SELECT event_id, rank() OVER o AS rank, dense_rank() OVER o AS dense_rank, round(percent_rank() OVER o, 9) AS percent_rank, round(cume_dist() OVER o, 9) AS cume_dist FROM events WINDOW o AS (ORDER BY value)")
def global_ranks(spark, d):
    """Ranks of all events by value, where values repeat, without a window of the whole table."""
    out = ranks.ranks(table(spark, d, "events").select("event_id", "value"), "value")
    return out.select("event_id", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query("SELECT event_id, (ntile(7) OVER (ORDER BY value, event_id))::INT AS tile FROM events")
def global_ntile(spark, d):
    return ranks.ntile(table(spark, d, "events").select("event_id", "value"), 7, "value", "event_id").select("event_id", "tile")


@query("SELECT event_id, count(user_id) OVER w AS n, sum(user_id)::BIGINT OVER w AS total, min(user_id) OVER w AS least, max(user_id) OVER w AS most FROM (SELECT event_id, user_id, round(value * 100)::BIGINT AS cents FROM events) WINDOW w AS (ORDER BY cents RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)".replace("sum(user_id)::BIGINT OVER w", "(sum(user_id) OVER w)::BIGINT"))
def global_range_frame(spark, d):
    """What happens at prices within half a unit of each event's."""
    x = table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return ranks.range_frame(x, "cents", 50, "user_id").select("event_id", F.col("frame_n").alias("n"), F.col("frame_sum").alias("total"), F.col("frame_min").alias("least"), F.col("frame_max").alias("most"))


@query("SELECT event_id, (sum(cents) OVER (ORDER BY ts, event_id))::BIGINT AS spent FROM (SELECT event_id, ts, round(value * 100)::BIGINT AS cents FROM events)")
def global_running_total(spark, d):
    x = table(spark, d, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return ranks.running_sums(x, {"before": "cents"}, "ts", "event_id").select("event_id", (F.col("before") + F.col("cents")).alias("spent"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20")
def first_rows(spark, d):
    """The debug subset: the first rows in order."""
    return rows.first(table(spark, d, "documents").select("doc_id", "text"), 20, "doc_id")


@query("SELECT item_id, text FROM benchmark")
def json_array_round_trip(spark, d):
    """Rows through one JSON array and back."""
    path = f"{scratch(spark, 'array')}.json"
    sources.write_json(table(spark, d, "benchmark").select("item_id", "text"), path, "item_id")
    return sources.read_json(spark, path, "item_id long, text string")
