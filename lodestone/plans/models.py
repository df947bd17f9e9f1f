"""Themes by a small network, messages over graphs, triples as rows, and the question loop."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import extraction, models
from lodestone.functions import vectors as vx
from lodestone.operators import corpora, graphs, networks, questions
from lodestone.plans.registry import query
from lodestone.tables import materialize, table

NAMES = [f"theme{i}" for i in range(10)]


def _layer(seed: int, n_out: int, n_in: int, activation: str) -> networks.Layer:
    """Weights that follow from their places."""
    i, j = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    return networks.Layer(((i * 73 + j * 179 + i * j * 7 + seed * 37) % 201 - 100) / 100.0, ((np.arange(n_out) * 31 + seed) % 21 - 10) / 20.0, activation)


def _layer_sql(seed: int, n_out: int, n_in: int, x: str) -> str:
    """The layer's outputs before the activation."""
    row = f"list_transform(range(0, {n_in}), lambda j: ((i * 73 + j * 179 + i * j * 7 + {seed * 37}) % 201 - 100) / 100.0::DOUBLE)"
    return f"list_transform(range(0, {n_out}), lambda i: list_dot_product({row}, {x}) + ((i * 31 + {seed}) % 21 - 10) / 20.0::DOUBLE)"


def _networks(n_in: int) -> tuple[list[networks.Layer], list[networks.Layer]]:
    return [_layer(1, 32, n_in, "relu"), _layer(2, 10, 32, "sigmoid")], [_layer(3, 16, 10, "relu"), _layer(4, 12, 16, "relu"), _layer(5, 10, 12, "softmax")]


def _themes_sql(source: str, n_in: int) -> str:
    """id, mode, labels, rank, theme, p for `source`: id, mode, v."""
    relu = lambda x: f"list_transform({x}, lambda y: greatest(y, 0))"
    return f"""WITH v AS ({source}), a1 AS (SELECT id, mode, {relu(_layer_sql(1, 32, n_in, 'v'))} AS x FROM v),
a2 AS (SELECT id, mode, list_transform({_layer_sql(2, 10, 32, 'x')}, lambda y: round(1 / (1 + exp(-y)), 9)) AS p FROM a1), a3 AS (SELECT *, {relu(_layer_sql(3, 16, 10, 'p'))} AS x FROM a2),
a4 AS (SELECT id, mode, p, {relu(_layer_sql(4, 12, 16, 'x'))} AS x FROM a3), a5 AS (SELECT id, mode, p, {_layer_sql(5, 10, 12, 'x')} AS x FROM a4), a6 AS (SELECT id, mode, p, list_transform(x, lambda y: exp(y - list_max(x))) AS x FROM a5),
a7 AS (SELECT id, mode, p, CASE WHEN mode = 'q' THEN list_transform(x, lambda y: round(y / list_sum(x), 9)) ELSE p END AS t FROM a6),
a8 AS (SELECT id, mode, array_to_string(list_transform(list_filter(range(0, 10), lambda i: p[i + 1] > 0.5), lambda i: 'theme' || i), ' ') AS labels, unnest(range(0, 10)) AS i, unnest(t) AS p FROM a7)
SELECT id, mode, labels, row_number() OVER (PARTITION BY id ORDER BY p DESC, i) AS rank, 'theme' || i AS theme, round(p, 6) AS p FROM a8 QUALIFY rank <= 3"""


def _ranked(df):
    """The three best themes of each row."""
    x = df.select("id", "mode", F.array_join("labels", " ").alias("labels"), F.posexplode("top").alias("k", "x"))
    return x.select("id", "mode", "labels", (F.col("k") + 1).alias("rank"), F.col("x.name").alias("theme"), F.round("x.p", 6).alias("p"))


@query(_themes_sql("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'q' ELSE 'd' END AS mode, embedding::DOUBLE[] AS v FROM embeddings", 64))
def theme_predict(spark, d):
    """Themes of vectors by classifier and, for questions, shifter."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "q").otherwise("d").alias("mode"), "embedding")
    return _ranked(networks.themes(rows, "embedding", *_networks(64), F.col("mode"), NAMES, 3))


@query(_themes_sql("SELECT vec_id AS id, 'd' AS mode, embedding::DOUBLE[] AS v FROM embeddings", 64))
def pip_theme_labels(spark, d):
    """Theme labels of a corpus whose first run left some rows out and gave zeros for others: both are predicted now, and
    merged with what was good. Equal to one whole run."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("d").alias("mode"), "embedding")
    predict = lambda df: networks.themes(df, "embedding", *_networks(64), F.col("mode"), NAMES, 3).drop("embedding")
    run = predict(rows.where("id % 3 <> 0"))
    failed = F.col("id") % 10 == 0
    run = materialize(run.withColumn("theme", F.when(failed, F.array_repeat(F.lit(0.0), len(NAMES))).otherwise(F.col("theme"))), "first_run")
    good = run.where(vx.norm(F.col("theme")) > 1e-8)
    return _ranked(good.unionByName(predict(corpora.missing(rows, good, "id"))))


COUNTS = "list_transform(range(0, 16), lambda k: len(list_filter(string_split(t, ''), lambda c: c <> '' AND unicode(c) % 16 = k))::DOUBLE)"
UNIT = "list_transform(x, lambda y: (y / CASE WHEN list_dot_product(x, x) = 0 THEN 1 ELSE sqrt(list_dot_product(x, x)) END)::FLOAT::DOUBLE)"


@query(_themes_sql(f"SELECT id, 'q' AS mode, {UNIT} AS v FROM (SELECT id, {COUNTS} AS x FROM (SELECT item_id AS id, coalesce(text, '') AS t FROM benchmark))", 16))
def theme_of_questions(spark, d):
    """From question texts through the encoder's hook, classifier and shifter to themes."""
    encoded = models.encode(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("q").alias("mode")), "text", models.stub_vector(16), "v")
    return _ranked(networks.themes(encoded, "v", *_networks(16), F.col("mode"), NAMES, 3))


def _rounds_sql(nodes: str, edges: str, dim: int, attention: bool) -> str:
    """Three rounds over nodes(node, h) and edges(src, dst)."""
    cosine = lambda a, b: f"coalesce(round(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 9), 0)"
    sql = f"WITH n AS ({nodes}), e AS ({edges}), r0 AS (SELECT node, h, 1 / sqrt(1 + coalesce(c, 0)) AS s FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) ON dst = node)"
    sums = ", ".join(f"sum(w * h[{i}])" for i in range(1, dim + 1))
    for k in range(3):
        if attention:
            w, own = f"exp({cosine('a.h', 'b.h')})", f"exp({cosine('h', 'h')})"
            a, b = f"(1 / ({own} + coalesce(t, 0)))", f"({own} / ({own} + coalesce(t, 0)))"
        else:
            w, a, b = "a.s", "s", "s * s"
        sql += f""", w{k} AS (SELECT dst, {w} AS w, a.h AS h FROM e JOIN r{k} a ON a.node = src JOIN r{k} b ON b.node = dst), m{k} AS (SELECT dst, sum(w) AS t, [{sums}] AS m FROM w{k} GROUP BY dst),
r{k + 1} AS (SELECT node, s, list_transform(range(1, {dim + 1}), lambda i: round({a} * coalesce(m[i], 0) + {b} * h[i], 9)) AS h FROM r{k} LEFT JOIN m{k} ON dst = node)"""
    return f"{sql} SELECT node, {', '.join(f'round(h[{i}], 6) AS h{i}' for i in range(1, dim + 1))} FROM r3"


def _flat(df, dim: int):
    return df.select("node", *[F.round(F.col("h")[i], 6).alias(f"h{i + 1}") for i in range(dim)])


PARTS = """SELECT 'p' || p_partkey AS node, [p_partkey % 7 / 7.0::DOUBLE, p_partkey % 11 / 11.0::DOUBLE, 1.0::DOUBLE] AS h FROM part UNION ALL SELECT 's' || s_suppkey, [s_suppkey % 7 / 7.0::DOUBLE, s_suppkey % 11 / 11.0::DOUBLE, 0.0::DOUBLE] FROM supplier"""
PART_EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem"


@query(_rounds_sql(PARTS, PART_EDGES, 3, False))
def gcn_rounds(spark, d):
    """Three rounds of degree-normalised messages between parts and suppliers."""
    def side(name, key, letter, last):
        k = F.col(key)
        return table(spark, d, name).select(F.concat(F.lit(letter), k.cast("string")).alias("node"), F.array(k % 7 / 7.0, k % 11 / 11.0, F.lit(last)).alias("h"))

    nodes = side("part", "p_partkey", "p", 1.0).unionByName(side("supplier", "s_suppkey", "s", 0.0))
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    pairs = pairs.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return _flat(graphs.propagate(nodes, pairs, 3, both=True), 3)


USERS = """SELECT DISTINCT 'u' || user_id AS node, [user_id % 7 / 7.0::DOUBLE, user_id % 5 / 5.0::DOUBLE, 1.0::DOUBLE] AS h FROM events UNION ALL SELECT DISTINCT 't' || event_type, [length(event_type) / 10.0::DOUBLE, unicode(event_type) / 100.0::DOUBLE, 0.0::DOUBLE] FROM events"""
USER_EDGES = "SELECT 'u' || user_id AS src, 't' || event_type AS dst FROM events UNION ALL SELECT 't' || event_type, 'u' || user_id FROM events"


@query(_rounds_sql(USERS, USER_EDGES, 3, True))
def attention_rounds(spark, d):
    """Three rounds of attention between users and the types of their events, which are hubs; an edge an event."""
    e = table(spark, d, "events").select("user_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("t"), "event_type").alias("t"))
    users = e.select(F.col("u").alias("node"), F.array(F.col("user_id") % 7 / 7.0, F.col("user_id") % 5 / 5.0, F.lit(1.0)).alias("h")).distinct()
    types = e.select(F.col("t").alias("node"), F.array(F.length("event_type") / 10.0, F.ascii("event_type") / 100.0, F.lit(0.0)).alias("h")).distinct()
    return _flat(graphs.propagate(users.unionByName(types), e.select(F.col("u").alias("src"), F.col("t").alias("dst")), 3, "attention", both=True), 3)


TRIPLES = """WITH s AS (SELECT doc_id, regexp_extract_all(unnest(string_split(text, '. ')), '[a-z]+') AS w FROM documents)"""


@query(f"""{TRIPLES}, x AS (SELECT doc_id, w[1] AS s, unnest(CASE WHEN len(w) > 3 THEN w[-2:] ELSE w[-1:] END) AS o FROM s WHERE len(w) > 2)
SELECT doc_id, s, 'mentions' AS p, o, count(*) AS n FROM x GROUP BY doc_id, s, o""")
def text_to_triples(spark, d):
    """The triples of each text, by a table function with a hook for the model."""
    extraction.register(spark, extraction.stub_reply)
    found = spark.sql("SELECT doc_id, t.* FROM {docs} AS d, LATERAL text_to_triples(d.text) AS t WHERE t.ok", docs=table(spark, d, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id", "s", "p", "o").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TRIPLES} SELECT doc_id, count(*) FILTER (len(w) = 2) AS malformed, coalesce(sum(CASE WHEN len(w) > 3 THEN 2 WHEN len(w) = 3 THEN 1 ELSE 0 END), 0)::BIGINT AS triples FROM s GROUP BY doc_id HAVING count(*) FILTER (len(w) > 1) > 0")
def triple_reply_stats(spark, d):
    """Triples and malformed parts of the replies."""
    extraction.register(spark, extraction.stub_reply)
    found = spark.sql("SELECT doc_id, t.ok FROM {docs} AS d, LATERAL text_to_triples(d.text) AS t", docs=table(spark, d, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("malformed"), F.count_if("ok").alias("triples"))


MAX_HOPS, ENOUGH = 4, 7


def stub_prompt(question: str, path: list[tuple[str, str]]) -> str:
    return "".join(f"{sub_query}\nRetrieved Graph Information: {triples}\n" for sub_query, triples in path) + f"Question: {question}"


def stub_plan(prompt: str) -> str:
    """Ask for the first object that was not asked for, until enough nodes are known."""
    nodes, objects, asked = (re.findall(p, prompt, re.MULTILINE) for p in ("[SO]> ([a-z]+)", "O> ([a-z]+)", "^Ask: ([a-z]+)$"))
    words = re.findall("[a-z]+", prompt.rpartition("Question: ")[2].split(". ")[0])
    if len(set(nodes)) >= ENOUGH:
        return "[SUFFICIENT]"
    left = [x for x in (objects if asked else words[-1:]) if x not in asked]
    return f"Ask: {left[0]}" if left else "[NO_RETRIEVAL]"


def stub_last(prompt: str) -> str:
    return ([None, *re.findall("O> ([a-z]+)", prompt)])[-1] or "unknown"


STUBS = questions.Models(extraction.stub_reply, stub_prompt, stub_plan, stub_last)


def _retrieval(spark, d):
    """Sub-query -> the first sentences of the two first documents that hold its word in theirs. Words are indexed by
    ids alone; a hop fetches the sentences of what it asks for."""
    first = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit(". "), F.lit(1)).alias("passage"))
    words = first.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("passage", F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    two = words.withColumn("nth", F.row_number().over(W.partitionBy("word").orderBy("doc_id"))).where("nth <= 2")
    index = materialize(two.select("word", "doc_id"), "index")
    passages = materialize(first.join(index.select("doc_id").distinct(), "doc_id", "left_semi"), "passages")

    def retrieve(asked):
        found = asked.select("id", F.regexp_extract("sub_query", "Ask: ([a-z]+)", 1).alias("word")).join(index, "word").select("id", "doc_id").join(passages, "doc_id")
        return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "passage")))["passage"].alias("docs"))

    return retrieve


def loop_sql(hops: int, more: int, subjects: str) -> str:
    """The loop in SQL; `more` words are read with each document, and `subjects` is what a hop adds to the subjects known."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(string_split(text, '. ')[1], '[a-z]+') AS w FROM documents),
x AS (SELECT word, doc_id, w FROM (SELECT doc_id, w, unnest(list_distinct(w)) AS word FROM w) QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id) <= 2),
i AS (SELECT word, flatten(list(CASE WHEN len(w) + {more} > 3 THEN w[-2:] WHEN len(w) + {more} = 3 THEN w[-1:] ELSE [] END ORDER BY doc_id)) AS o, flatten(list(CASE WHEN len(w) > 2 THEN w[:1] ELSE [] END ORDER BY doc_id)) AS s FROM x GROUP BY word),
r AS (SELECT item_id AS id, 0 AS hops, regexp_extract_all(string_split(text, '. ')[1], '[a-z]+')[-1] AS word, []::VARCHAR[] AS asked, []::VARCHAR[] AS objects, []::VARCHAR[] AS subjects FROM benchmark
 UNION ALL SELECT id, hops + 1, CASE WHEN hops + 1 < {hops} AND len(list_distinct(list_concat(o2, s2))) < {ENOUGH} THEN list_filter(o2, lambda y: NOT list_contains(list_append(asked, word), y))[1] END, list_append(asked, word), o2, s2
 FROM (SELECT r.*, list_concat(objects, coalesce(o, [])) AS o2, list_concat(subjects, {subjects}) AS s2 FROM r LEFT JOIN i USING (word) WHERE word IS NOT NULL))
SELECT id, hops, CASE WHEN hops >= {hops} THEN 'maximum' WHEN len(list_distinct(list_concat(objects, subjects))) >= {ENOUGH} THEN 'sufficient' ELSE 'no_retrieval' END AS reason, coalesce(objects[-1], 'unknown') AS answer FROM r WHERE word IS NULL"""


LOOP = loop_sql(MAX_HOPS, 0, "coalesce(s, [])")


@query(LOOP)
def question_loop(spark, d):
    """Plan, retrieve, extract, extend, decide and answer, hop by hop for all open questions."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return questions.answer_in_rounds(asked, _retrieval(spark, d), STUBS, MAX_HOPS).drop("path")


@query(LOOP)
def question_loop_online(spark, d):
    """The same loop with each question's path in the state store of a stream."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return questions.answer_online(asked, _retrieval(spark, d), STUBS, MAX_HOPS)


def with_question(question: str, document: str) -> str:
    """The question's last word before the document's words, so that it becomes the subject."""
    return " ".join([*re.findall("[a-z]+", question.split(". ")[0])[-1:], *re.findall("[a-z]+", document)])


@query(loop_sql(5, 1, "CASE WHEN len(coalesce(o, [])) > 0 THEN [coalesce(asked[1], word)] ELSE [] END"))
def question_loop_with_question(spark, d):
    """The variant whose extraction sees the question, with five hops at most."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    models = questions.Models(extraction.stub_reply, stub_prompt, stub_plan, stub_last, with_question)
    return questions.answer_in_rounds(asked, _retrieval(spark, d), models, 5).drop("path")
