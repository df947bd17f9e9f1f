"""Training-set queries. Orders stand for questions, their lines for facts, parts for titled articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.functions.models import similarity_label
from lodestone.operators import retrieval as rt
from lodestone.operators import corpora, reasoning, rows, trainset
from lodestone.plans.registry import query
from lodestone.plans.texts import TRIPLES, triples
from lodestone.tables import table


def _facts(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


@query("SELECT l_orderkey, lower(p_name) AS title, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS sentences FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, lower(p_name)")
def facts_by_title(spark, d):
    g = _facts(spark, d).groupBy("l_orderkey", F.lower("p_name").alias("title")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))
    return g.select("l_orderkey", "title", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sentences"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 10 <> 0)")
def all_supporting_present(spark, d):
    have = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return trainset.complete_only(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), have, "l_orderkey", "l_partkey")


@query("SELECT p.p_partkey, m.first AS article FROM part p JOIN (SELECT lower(p_name) AS t, min(p_partkey) AS first FROM part GROUP BY lower(p_name)) m ON lower(p.p_name) = m.t")
def title_ci_join(spark, d):
    part = table(spark, d, "part")
    articles = part.groupBy(F.lower(F.upper("p_name")).alias("t")).agg(F.min_by("p_partkey", "p_partkey").alias("article"))
    return part.select("p_partkey", F.lower("p_name").alias("t")).join(articles, "t").select("p_partkey", "article")


@query("WITH x AS (SELECT conv_id, list(text ORDER BY turn) AS c FROM conversations GROUP BY conv_id) SELECT conv_id, len(list_filter([0, 1, 2, 5], lambda i: i + 1 < len(c))) AS n, md5(array_to_string(list_transform(list_filter([0, 1, 2, 5], lambda i: i + 1 < len(c)), lambda i: c[i + 2]), '|')) AS sentences_md5 FROM x")
def sentence_gather(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("c"))
    kept = F.filter(F.array(*map(F.lit, (0, 1, 2, 5))), lambda i: i + 1 < F.size("c"))
    return c.select("conv_id", F.size(kept).cast("long").alias("n"), F.md5(F.array_join(F.transform(kept, lambda i: F.get("c", i + 1)), "|")).alias("sentences_md5"))


@query("SELECT o_orderkey, o_orderpriority AS answer FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR o_orderkey % 7 = 0")
def anti_join_questions(spark, d):
    o = table(spark, d, "orders")
    asked = o.withColumn("input", F.when(F.col("o_orderkey") % 7 == 0, F.lit("no marker")).otherwise(F.concat(F.lit("Do.\nQuestion:  "), F.col("o_orderkey").cast("string"), F.lit(" "))))
    seen = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key")).distinct()
    return asked.withColumn("key", tx.question_key(F.col("input"))).join(seen, "key", "left_anti").select("o_orderkey", F.col("o_orderpriority").alias("answer"))


REPLIES = "CASE l_orderkey % 5 WHEN 0 THEN 'Documents 1, 3 help.' WHEN 1 THEN 'none of them' WHEN 2 THEN '9,1' WHEN 3 THEN 'only 2' ELSE '1 , 2 and 7' END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, regexp_extract({REPLIES}, '[0-9]+( *, *[0-9]+)*') AS r FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
c AS (SELECT *, list_transform(string_split(r, ','), lambda k: trim(k)::BIGINT) AS k FROM x WHERE r <> '') SELECT l_orderkey, l_linenumber FROM c WHERE list_contains(k, i) OR list_max(k) > n""")
def doc_index_filter(spark, d):
    """Replies that name documents, none, or one that is not there."""
    docs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(REPLIES).alias("reply"))
    return trainset.select_docs(docs, "l_orderkey", "l_linenumber", "reply").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS titles, count(*) AS docs FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey")
def map_filter_docs(spark, d):
    by_title = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.collect_list("l_quantity").alias("docs"))
    maps = by_title.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "docs"))).alias("m"))
    kept = F.map_filter(F.transform_values("m", lambda k, v: F.filter(v, lambda x: x > 25)), lambda k, v: F.size(v) > 0)
    return maps.select("l_orderkey", kept.alias("m")).where(F.size("m") > 0).select("l_orderkey", F.size("m").cast("long").alias("titles"), F.size(F.flatten(F.map_values("m"))).cast("long").alias("docs"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_partkey = l.l_partkey AND k.l_quantity > 25)")
def semi_join_topic(spark, d):
    line = table(spark, d, "lineitem")
    kept = line.where("l_quantity > 25").select("l_orderkey", "l_partkey")
    return line.join(kept, ["l_orderkey", "l_partkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT vec_id, s AS similarity, s < 0.8 AS needs_subquery, CASE WHEN s < 0.8 THEN '[SUBQ=YES]' ELSE '[SUBQ=NO] No subquery is needed.' END AS label FROM (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10 UNION ALL SELECT vec_id, 1.0 FROM embeddings WHERE vec_id % 10 = 0)")
def threshold_label(spark, d):
    """Cosine of an answer's vector and a gold's: another of its label, or for some the same vector."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    other = e.select((F.col("vec_id") - 10).alias("vec_id"), F.col("embedding").alias("gold"), "label")
    pairs = e.join(other, ["vec_id", "label"]).unionByName(e.where("vec_id % 10 = 0").withColumn("gold", F.col("embedding")))
    scored = pairs.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("gold")), 6).alias("s"))
    return scored.select("vec_id", F.col("s").alias("similarity"), (F.col("s") < 0.8).alias("needs_subquery"), similarity_label(F.col("s")).alias("label"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, max(round(list_dot_product(q.v, x.v), 6)) AS best FROM v q, v x WHERE q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id GROUP BY q.vec_id) SELECT query_id, best, best >= 0.8 AS can_answer FROM s WHERE query_id IN (SELECT doc_id FROM labels)")
def threshold_retrieval(spark, d):
    """Whether the best retrieved vector answers the question; unlabelled questions are dropped."""
    vecs = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    found = rt.topk(vecs, vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 2).where("vec_id <> query_id")
    best = found.groupBy("query_id").agg(F.max("score").alias("best"))
    answered = table(spark, d, "labels").select(F.col("doc_id").alias("query_id")).distinct()
    return best.join(answered, "query_id", "left_semi").select("query_id", "best", (F.col("best") >= 0.8).alias("can_answer"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON trim(b.text) = trim(d.text) UNION ALL SELECT item_id, item_id FROM benchmark")
def question_retrieval_join(spark, d):
    b = table(spark, d, "benchmark")
    found = table(spark, d, "documents").select("doc_id", F.trim("text").alias("k")).unionByName(b.select(F.col("item_id").alias("doc_id"), F.trim(F.concat(F.lit("  "), "text", F.lit(" "))).alias("k")))
    return corpora.text_join(b.select("item_id", F.trim("text").alias("k")), found, "k", ["item_id"], ["doc_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'new ' || o_orderpriority WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'new ' || o_orderpriority END AS answer FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F'")
def answer_map_override(spark, d):
    o = table(spark, d, "orders")
    base = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("answer"))
    over = o.where("o_orderstatus = 'F'").select("o_orderkey", F.concat(F.lit("new "), "o_orderpriority").alias("answer"))
    return trainset.override(base, over, "o_orderkey", "answer")


@query(f"WITH k AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 10 <> 0)) SELECT l_orderkey, count(*) AS n, string_agg(t, ', ' ORDER BY l_linenumber, t) AS triples FROM {TRIPLES} WHERE l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY l_orderkey")
def doc_triples_join(spark, d):
    t = triples(spark, d)
    known = t.where("l_partkey % 10 <> 0").select("l_partkey").distinct()
    keys = trainset.complete_only(t.select("l_orderkey", "l_partkey"), known, "l_orderkey", "l_partkey")
    g = t.join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("x"))
    return g.select("l_orderkey", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda s: s["t"]), ", ").alias("triples"))


@query("SELECT l_orderkey, l_partkey, max_by(l_shipdate, (l_linenumber, l_shipdate))::DATE::VARCHAR AS sub_query FROM lineitem GROUP BY l_orderkey, l_partkey")
def doc_subquery_map(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("s"))
    return last.select("l_orderkey", "l_partkey", F.col("s").cast("date").cast("string").alias("sub_query"))


PREFIX = "string_agg({0}, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT conv_id, turn, md5('Q:' || {PREFIX.format('text')}) AS input_md5, coalesce('[SUBQ] ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[SUFFICIENT]') AS label FROM conversations WHERE role = 'user'")
def planner_prefix_examples(spark, d):
    steps = table(spark, d, "conversations").where("role = 'user'").withColumn("ask", F.col("text"))
    return trainset.prefix_examples(steps, "conv_id", "turn", "text", "ask", "Q:").select("conv_id", "turn", F.md5("input").alias("input_md5"), "label")


@query("SELECT conv_id, md5(string_agg('Step ' || (turn + 1) || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id")
def trajectory_prompt(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("t", lambda s: F.concat(F.lit("Step "), (s["turn"] + 1).cast("string"), F.lit(": "), s["text"])), "\n")).alias("prompt_md5"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS score, ceil(l_quantity)::BIGINT AS tokens FROM lineitem)
SELECT l_orderkey, l_linenumber, sum(tokens) OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM x QUALIFY used <= 80""")
def context_pack(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"), F.ceil("l_quantity").alias("tokens"))
    return trainset.pack(x, "l_orderkey", "score", "tokens", 80, "l_linenumber").select("l_orderkey", "l_linenumber", "used")


@query("""WITH m AS (SELECT conv_id, min(turn) AS m FROM conversations WHERE role = 'user' AND length(text) > 0 GROUP BY conv_id)
SELECT conv_id, CASE WHEN turn = m THEN 'main' ELSE 'sub' END AS type, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 2)::INT AS sub_idx FROM conversations JOIN m USING (conv_id) WHERE role = 'user' AND turn >= m""")
def flatten_queries(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    q = q.where(F.length(F.get("q", F.lit(0))["text"]) > 0)
    subs = F.slice("q", F.lit(2), F.greatest(F.size("q") - 1, F.lit(0)))
    main = q.select("conv_id", F.lit("main").alias("type"), F.lit(-1).alias("sub_idx"))
    return main.unionByName(q.select("conv_id", F.lit("sub").alias("type"), F.posexplode(subs).alias("sub_idx", "x")).drop("x"))


def question_columns(b):
    """Parallel lists of questions and contexts: a row for each 1,000 ids, so that no row holds the table."""
    return b.groupBy(F.expr("item_id div 1000").alias("block")).agg(F.collect_list("text").alias("question"), F.collect_list("item_id").alias("context")).drop("block")


@query("SELECT text AS question, max_by(item_id, item_id) AS context FROM (SELECT text, item_id FROM benchmark UNION ALL SELECT text, item_id + 1000 FROM benchmark WHERE item_id % 2 = 0) GROUP BY text")
def question_context_map(spark, d):
    b = table(spark, d, "benchmark")
    columns = question_columns(b)
    again = question_columns(b.where("item_id % 2 = 0").withColumn("item_id", F.col("item_id") + 1000))
    pairs = columns.unionByName(again).select(F.inline(F.arrays_zip("question", "context")))
    return pairs.groupBy("question").agg(F.max_by("context", "context").alias("context"))


@query("WITH x AS (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, p_name) AS i FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, string_agg('[' || i || '] ' || p_name, chr(10) ORDER BY i) AS block FROM x GROUP BY l_orderkey")
def numbered_docs(spark, d):
    g = _facts(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "p_name"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["p_name"])), "\n").alias("block"))


@query("""WITH k AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 10 <> 0)) SELECT l_orderkey, lower(p_name) AS title, count(*) AS n, string_agg(p_type || l_linenumber, '|' ORDER BY l_linenumber, p_type) AS docs
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY l_orderkey, lower(p_name)""")
def pip_hotpot(spark, d):
    facts = _facts(spark, d)
    have = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    whole = trainset.complete_only(facts.select("l_orderkey", "l_partkey"), have, "l_orderkey", "l_partkey")
    g = facts.join(whole, "l_orderkey", "left_semi").groupBy("l_orderkey", F.lower("p_name").alias("title")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_type"))).alias("x"))
    return g.select("l_orderkey", "title", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda s: F.concat(s["p_type"], s["l_linenumber"].cast("string"))), "|").alias("docs"))


PLANNER = f"""u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, -1 AS turn, 'Question: ' || text AS input, CASE WHEN n = 1 THEN '[NO_RETRIEVAL]' ELSE '[SUBQ] ' || text END AS label FROM u WHERE i = 1
UNION ALL SELECT conv_id, turn, 'Question: ' || first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || {PREFIX.format("text")}, coalesce('[SUBQ] ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[SUFFICIENT]') FROM u WHERE n > 1),
p AS (SELECT *, conv_id || ':' || turn AS id FROM e), o AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS pos, count(*) OVER () AS total FROM p),
s AS (SELECT conv_id, turn, input, label, CASE WHEN pos < floor(total * 0.98::DOUBLE) THEN 'train' WHEN pos < floor(total * 0.99::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o)"""


def _planner(spark, d):
    u = table(spark, d, "conversations").where("role = 'user'").withColumn("ask", F.col("text"))
    first = u.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min_by("ask", "turn").alias("q0"), F.count(F.lit(1)).alias("n"))
    ask = F.concat(F.lit("Question: "), "question")
    alone = first.select("conv_id", F.lit(-1).cast("long").alias("turn"), ask.alias("input"), F.when(F.col("n") == 1, "[NO_RETRIEVAL]").otherwise(F.concat(F.lit("[SUBQ] "), "q0")).alias("label"))
    steps = trainset.prefix_examples(u, "conv_id", "turn", "text", "ask").join(first.where("n > 1"), "conv_id")
    steps = steps.select("conv_id", "turn", F.concat(ask, F.lit("\n"), "input").alias("input"), "label")
    every = alone.unionByName(steps).withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return rows.split_by_shares(every, "id", {"train": 0.98, "val": 0.01, "test": 0.01})


@query(f"WITH {PLANNER} SELECT conv_id, turn, md5(input) AS input_md5, label, split FROM s")
def pip_planner(spark, d):
    return _planner(spark, d).select("conv_id", "turn", F.md5("input").alias("input_md5"), "label", "split")


@query(f"""WITH {PLANNER}, a AS (SELECT conv_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, turn, md5('Answer it.' || chr(10) || input) AS input_md5, answer AS label FROM s JOIN a USING (conv_id) WHERE label IN ('[SUFFICIENT]', '[NO_RETRIEVAL]')""")
def pip_answerer(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    done = _planner(spark, d).where(F.col("label").isin("[SUFFICIENT]", "[NO_RETRIEVAL]")).withColumn("instruction", F.concat(F.lit("Plan it.\n"), "input"))
    return done.join(answers, "conv_id").select("conv_id", "turn", F.md5(F.replace("instruction", F.lit("Plan it.\n"), F.lit("Answer it.\n"))).alias("input_md5"), F.col("answer").alias("label"))


@query("SELECT item_id, split_part(replace(text, chr(10), ' '), '. ', 1) AS output FROM benchmark")
def model_boundary_stub(spark, d):
    from lodestone.functions.models import generate, stub_answer

    prompts = table(spark, d, "benchmark").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return generate(prompts, "text", stub_answer).select("item_id", "output")


# Question sets: an order is a question, its lines are its documents.

def _items(spark, d):
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    g = _facts(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ctxs"))
    key = F.col("l_orderkey").cast("string")
    return g.select("l_orderkey", key.alias("question"), F.array(key).alias("answers"), key.alias("answer"), "ctxs", F.col("ctxs").alias("docs"), F.transform("ctxs", lambda c: F.array(c["title"], c["text"])).alias("context"), F.concat(F.lit("title "), key).alias("s_wiki_title"), F.lit("author").alias("prop"), F.concat(F.lit("claim "), key).alias("claim"), F.when(F.col("l_orderkey") % 2 == 0, "true").otherwise("false").alias("label"))


ITEMS = "(SELECT l_orderkey, l_orderkey::VARCHAR AS question, list(p_name ORDER BY l_linenumber, p_name, p_type) AS titles, list(p_type ORDER BY l_linenumber, p_name, p_type) AS texts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"


@query(f"SELECT question, question AS answer, array_to_string(texts[1:5], '|') AS context, 'title ' || question AS s_wiki_title, 'author' AS prop FROM {ITEMS}")
def adapt_ranked(spark, d):
    return trainset.adapt(_items(spark, d), "ranked").select("question", F.array_join("answer", "|").alias("answer"), F.array_join("context", "|").alias("context"), "s_wiki_title", "prop")


@query(f"SELECT question, question AS answer, array_to_string(texts[1:5], '|') AS context, 'claim ' || question AS claim, CASE WHEN l_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS label FROM {ITEMS}")
def adapt_claims(spark, d):
    return trainset.adapt(_items(spark, d), "claims").select("question", F.array_join("answer", "|").alias("answer"), F.array_join("context", "|").alias("context"), "claim", "label")


@query(f"SELECT question, array_to_string(titles, '|') AS answer, array_to_string(texts, '|') AS context FROM {ITEMS}")
def adapt_pairs(spark, d):
    return trainset.adapt(_items(spark, d), "pairs").select("question", F.array_join("answer", "|").alias("answer"), F.array_join("context", "|").alias("context"))


@query(f"SELECT question, question AS answer, array_to_string(texts, '|') AS context FROM {ITEMS}")
def adapt_all_docs(spark, d):
    return trainset.adapt(_items(spark, d), "all_docs").select("question", "answer", F.array_join("context", "|").alias("context"))


@query(f"SELECT question, question AS answer FROM {ITEMS}")
def adapt_plain(spark, d):
    return trainset.adapt(_items(spark, d), "plain")


@query(f"SELECT l_orderkey, array_to_string(list_transform(range(1, len(texts) + 1), lambda i: 'Document [' || i || '](Title: ' || titles[i] || '): ' || texts[i]), chr(10)) AS titled, array_to_string(list_transform(range(1, len(texts) + 1), lambda i: 'Document [' || i || ']: ' || texts[i]), chr(10)) AS plain FROM {ITEMS}")
def document_blocks(spark, d):
    return _items(spark, d).select("l_orderkey", tx.titled_documents(F.col("ctxs.title"), F.col("ctxs.text")).alias("titled"), tx.plain_documents(F.col("ctxs.text")).alias("plain"))


TASKS = {"fever": "Verify it.", "asqa": "Answer at length. "}


@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Verify it.' || chr(10) || chr(10) || '### Input:' || chr(10) || text WHEN 1 THEN 'Answer at length. ' || text ELSE text END AS instruction FROM conversations WHERE role = 'user'""")
def task_instruction(spark, d):
    k = F.col("conv_id") % 3
    task = F.when(k == 0, "fever").when(k == 1, "asqa").otherwise("other")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", tx.instruction(task, F.col("text"), TASKS, {"fever": "\n\n### Input:\n"}).alias("instruction"))


@query("""WITH x AS (SELECT conv_id, turn, text, conv_id % 3 AS k, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'out ' || turn END AS o FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'in ' || text WHEN 1 THEN coalesce(CASE WHEN turn % 2 = 0 THEN 'do ' || turn END, text) ELSE 'Answer at length. ## Input:' || chr(10) || chr(10) || text END AS asks, CASE k WHEN 0 THEN coalesce(o, 'topic') ELSE coalesce(CASE WHEN turn % 3 = 0 THEN 'gold' END, o) END AS gold FROM x""")
def model_inputs(spark, d):
    k, turn = F.col("conv_id") % 3, F.col("turn").cast("string")
    task = F.when(k == 0, "factscore").when(k == 1, "qa").otherwise("asqa")
    item = {"input": F.concat(F.lit("in "), "text"), "instruction": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("do "), turn)), "question": F.col("text"), "topic": F.lit("topic"), "output": F.when(F.col("turn") % 4 != 0, F.concat(F.lit("out "), turn)), "answers": F.when(F.col("turn") % 3 == 0, F.array(F.lit("gold")))}
    asks, golds = tx.model_input(task, item, TASKS)
    return table(spark, d, "conversations").select("conv_id", "turn", asks.alias("asks"), golds[0].alias("gold"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN text || '  end' ELSE text END, '\s+', ' ', 'g')) AS answer FROM conversations""")
def chat_answers(spark, d):
    reply = F.concat(F.lit("[INST] ask [/INST]  "), "text", F.when(F.col("turn") % 2 == 0, "  end[/INST] more").otherwise("\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.chat_answer(reply).alias("answer"))


@query(f"""WITH u AS (SELECT conv_id, turn, text, '[SUBQ] ' || text || chr(10) || 'Retrieved Graph Information: ' || turn AS line FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, 'Plan it.' || chr(10) || {PREFIX.format("line")} AS input, coalesce('[SUBQ] ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[SUFFICIENT]') AS label FROM u)
SELECT min_by(conv_id, (conv_id, turn)) AS conv_id, min_by(turn, (conv_id, turn)) AS turn, md5(input) AS input_md5, min_by(label, (conv_id, turn)) AS label FROM e WHERE input NOT IN (SELECT input FROM e WHERE conv_id % 7 = 0) GROUP BY input""")
def planner_graph_prefixes(spark, d):
    """Sub-queries with what was found for each; inputs that are done already are left out."""
    u = table(spark, d, "conversations").where("role = 'user'").withColumn("found", F.col("turn").cast("string"))
    done = trainset.graph_prefixes(u.where("conv_id % 7 = 0"), "conv_id", "turn", "text", "found", "Plan it.").select("input")
    return trainset.graph_prefixes(u, "conv_id", "turn", "text", "found", "Plan it.", done).select("conv_id", "turn", F.md5("input").alias("input_md5"), "label")


@query("SELECT i.doc_id, f.doc_id AS found FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id % 2 = 0) i JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id % 2 = 1) f USING (pos)")
def retrieval_by_position(spark, d):
    """A retrieval file without ids belongs to its questions by row position."""
    docs = table(spark, d, "documents").select("doc_id")
    items, found = (rows.number(docs.where(f"doc_id % 2 = {k}"), "doc_id") for k in (0, 1))
    return trainset.paragraphs_of(items, found.withColumnRenamed("doc_id", "found"), None, "found").select("doc_id", "found")


@query("SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 200")
def sample_200(spark, d):
    """A seeded sample of a stated size."""
    return table(spark, d, "documents").select("doc_id").orderBy(rows.hash_order(F.col("doc_id"), 5), "doc_id").limit(200)


@query("SELECT event_id, 'run-' || (event_id % 1000) || '.ckpt' AS file, row_number() OVER (ORDER BY event_id % 1000, event_id) - 1 AS pos FROM events")
def files_by_number(spark, d):
    """Files in the order of the number in their names, not of the names."""
    files = table(spark, d, "events").select("event_id", F.concat(F.lit("run-"), (F.col("event_id") % 1000).cast("string"), F.lit(".ckpt")).alias("file"))
    return rows.number(files.withColumn("k", F.regexp_extract("file", r"(\d+)", 1).cast("long")), "k", "event_id").select("event_id", "file", "pos")


CASES = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), r AS (SELECT q.vec_id AS query_id, x.vec_id, q.label AS wanted, x.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, x.v), 6) DESC, x.vec_id) AS rank FROM v q, v x WHERE q.vec_id % 50 = 0),
t AS (SELECT query_id, wanted, min(rank) AS k FROM r WHERE label = wanted AND vec_id <> query_id GROUP BY ALL)"""


@query(f"{CASES} SELECT query_id, 'Query ' || query_id || ' (label ' || wanted || '): best document at rank ' || k || CASE WHEN k <= 10 THEN ', found' ELSE ', missed' END AS line, least((k - 1) // 10, 9) AS bin FROM t")
def case_report(spark, d):
    """A line of text a query, and its bin of ten ranks for a histogram."""
    vecs = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    ranks = rt.target_ranks(vecs, vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label"))
    line = F.concat(F.lit("Query "), F.col("query_id").cast("string"), F.lit(" (label "), F.col("label").cast("string"), F.lit("): best document at rank "), F.col("target_rank").cast("string"), F.when(F.col("target_rank") <= 10, ", found").otherwise(", missed"))
    return ranks.select("query_id", line.alias("line"), F.least(F.expr("(target_rank - 1) div 10"), F.lit(9)).alias("bin"))


# Several model calls a question, with stand-ins for the model that read what the prompts say.

def _asks(prompts: list[str]) -> list[str]:
    """The third question of a key gets no proper reply."""
    out = []
    for p in prompts:
        n = p.count("\n- ")
        out.append("none" if n == 2 else f' "Which part is {p.split(chr(10))[1]}, number {n}?" ')
    return out


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, lower(p_name) AS topic, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lower(p_name)) - 1 AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 2 THEN 'What does this document tell us about ' || topic || '?' ELSE 'Which part is ' || topic || ', number ' || n || '?' END AS sub_query, n = 2 AS is_fallback FROM x""")
def pip_subqueries(spark, d):
    """A question for each document of an order, asked with those before it."""
    docs = _facts(spark, d).select("l_orderkey", "l_linenumber", F.lower("p_name").alias("topic"))
    prompt = lambda row, before: "\n".join([f"Ask about this part of order {row['l_orderkey']}.", row["topic"], "Asked:", *[f"- {q}" for q in before]])
    return reasoning.sub_queries(docs, "l_orderkey", ["l_linenumber", "topic"], "topic", _asks, prompt).drop("topic")


def _reads(prompts: list[str]) -> list[str]:
    """By a prompt's first line; even questions get a JSON list, those divisible by three an object as choice."""
    out = []
    for p in prompts:
        kind, q, rest = p.split("\n", 2)
        if kind == "propose":
            out.append(f'["a {q}", "b {q}"]' if int(q) % 2 == 0 else f"x {q} , y {q}, z,w")
        elif kind == "sum up":
            out.append(f"{rest.split(chr(10))[0]} in {rest.count('[')}")
        else:
            last = rest.rsplit("Candidate '", 1)[1].split("'")[0]
            out.append(f'{{"final_answer": "{last}"}}' if int(q) % 3 == 0 else "unsure")
    return out


@query(f"""WITH x AS (SELECT l_orderkey, question AS q, least(len(texts), 5) AS k, CASE WHEN l_orderkey % 2 = 0 THEN ['a ' || question, 'b ' || question] ELSE ['x ' || question, 'y ' || question, 'z'] END AS c FROM {ITEMS})
SELECT l_orderkey, array_to_string(c, '|') AS candidates, array_to_string(list_transform(c, lambda v: v || ' in ' || k), '|') AS summaries, CASE WHEN l_orderkey % 3 = 0 THEN c[-1] ELSE c[1] END AS output FROM x""")
def pip_candidates(spark, d):
    """Candidates, a summary of the documents for each, and a choice."""
    items = _items(spark, d).select("l_orderkey", "question", tx.evidence_block(F.col("ctxs.title"), F.col("ctxs.text"), 5).alias("passages"))
    lines = lambda *parts: F.concat_ws("\n", *parts)
    got = reasoning.answer_by_candidates(
        items, "l_orderkey", "question", "passages", _reads, lambda q: lines(F.lit("propose"), q, F.lit("")),
        lambda q, c, p: lines(F.lit("sum up"), q, c, p), lambda q, s: lines(F.lit("verify"), q, s))
    return got.select("l_orderkey", F.array_join("candidates", "|").alias("candidates"), F.array_join("summaries", "|").alias("summaries"), "output")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(embedding[len(embedding)]::DOUBLE, 6) ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def theme_mode(spark, d):
    """Questions' distributions are shifted (here: turned round), documents' are not."""
    mode = F.when(F.col("vec_id") % 2 == 0, "q").otherwise("d")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(vx.theme_of(F.col("embedding"), mode, F.reverse), F.lit(0)).cast("double"), 6).alias("first"))
