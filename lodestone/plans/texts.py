"""Text, prompt and triple queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import triples as tr
from lodestone.plans.registry import query
from lodestone.tables import table


def norm_sql(x: str) -> str:
    """The normalised answer in SQL: articles are dropped from the list of words."""
    bare = rf"regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+')"
    return f"array_to_string(list_filter({bare}, lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def overlap_sql(p: str, g: str) -> str:
    """F1 of two lists of words as multisets."""
    same = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w))))), 0)"
    return f"CASE WHEN {same} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {same} / (len({p}) + len({g})) END"


def f1_sql(p: str, g: str) -> str:
    words = lambda x: f"list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> '')"
    return overlap_sql(words(p), words(g))


@query("SELECT doc_id, text, n_chars FROM documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "n_chars")


@query(r"SELECT page_id, md5(regexp_replace(html, '<a href=\"[^\"]*\">([^<]+)</a>', '\1', 'g')) AS text_md5 FROM pages".replace('\\"', '"'))
def html_anchor_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.anchors_to_text(F.col("html"))).alias("text_md5"))


@query("SELECT doc_id, coalesce(nullif(text, ''), '[INVALID_TEXT]') AS text FROM documents")
def null_text_fill(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), F.lit("[INVALID_TEXT]")).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, text, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM documents)
SELECT doc_id, length(text) AS n FROM s WHERE length(t) >= 3 AND length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) / length(text)::DOUBLE <= 0.3 AND NOT regexp_matches(text, '[^\x00-\x7F]') AND t NOT IN ('.', '...', '. . .')""")
def clean_documents(spark, d):
    return table(spark, d, "documents").where(tx.is_clean(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_answer(F.col("text"))).alias("norm_md5"))


def _answers(spark, d):
    """Predictions and golds: each benchmark passage against its first and last sentence and what follows its first."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.col("text").alias("p"), F.split("text", r"\. ").alias("golds"), F.lower(F.regexp_replace("text", r"^[^.]*\. ", "")).alias("g"))


ANSWERS = r"(SELECT item_id, text AS p, string_split(text, '. ') AS golds, lower(regexp_replace(text, '^[^.]*\. ', '')) AS g FROM benchmark)"


@query(f"SELECT item_id, round({f1_sql('p', 'g')}, 9) AS f1, round(list_max(list_transform(golds, lambda q: {f1_sql('p', 'q')})), 9) AS best_f1 FROM {ANSWERS}")
def token_f1(spark, d):
    return _answers(spark, d).select("item_id", F.round(tx.token_f1(F.col("p"), F.col("g")), 9).alias("f1"), F.round(tx.best_f1(F.col("p"), F.col("golds")), 9).alias("best_f1"))


@query(f"SELECT item_id, len(list_filter(golds, lambda q: contains({norm_sql('p')}, {norm_sql('q')}))) > 0 AS hit, contains({norm_sql('p')}, {norm_sql('g')}) AS hit_start FROM {ANSWERS}")
def match_metric(spark, d):
    return _answers(spark, d).select("item_id", (tx.matches(F.col("p"), F.col("golds")) == 1).alias("hit"), (tx.matches(F.col("p"), F.array("g")) == 1).alias("hit_start"))


@query(f"SELECT item_id, len(list_filter(golds, lambda q: contains(p, q))) > 0 AS hit, contains(p, g) AS hit_start FROM {ANSWERS}")
def match_raw(spark, d):
    return _answers(spark, d).select("item_id", (tx.matches(F.col("p"), F.col("golds"), False) == 1).alias("hit"), (tx.matches(F.col("p"), F.array("g"), False) == 1).alias("hit_start"))


@query(f"SELECT item_id, contains(lower(p), lower(golds[1])) AS correct FROM {ANSWERS}")
def accuracy_contains(spark, d):
    return _answers(spark, d).select("item_id", F.contains(F.lower("p"), F.lower(F.col("golds")[0])).alias("correct"))


@query(r"""WITH x AS (SELECT c_custkey, c_name || ' <' || c_mktsegment || '> nation ' || c_nationkey || ' <place>' AS s FROM customer)
SELECT c_custkey, c_name AS entity, regexp_extract(s, '<(.+?)>', 1) AS tag, 2::BIGINT AS n FROM x JOIN customer USING (c_custkey)""")
def entity_tags(spark, d):
    s = F.concat(F.col("c_name"), F.lit(" <"), F.col("c_mktsegment"), F.lit("> nation "), F.col("c_nationkey").cast("string"), F.lit(" <place>"))
    pairs = table(spark, d, "customer").select("c_custkey", tx.entity_tags(s).alias("t"))
    return pairs.select("c_custkey", F.element_at("t", -1)["k"].alias("entity"), F.element_at("t", -1)["v"].alias("tag"), F.size("t").cast("long").alias("n"))


@query(r"SELECT doc_id, replace(replace(regexp_replace(regexp_replace(replace(text, ' the ', ' [12] | the '), ' \[\d+', '', 'g'), '\[\d+', '', 'g'), ' |', ''), ']', '') AS t FROM documents")
def remove_citations(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.remove_citations(F.replace("text", F.lit(" the "), F.lit(" [12] | the "))).alias("t"))


@query(r"SELECT doc_id, regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:100], ' '), '[!-/:-@\[-`{-~]+$', '') AS t FROM documents")
def first_100_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_tokens(F.col("text")).alias("t"))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(' [Retrieval]' || text || '[Utility:5]</s>', '[Retrieval]', ''), '[Utility:5]', ''), '</s>', ''), '^ ', '') AS t FROM documents")
def strip_control_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.strip_control_tokens(F.concat(F.lit(" [Retrieval]"), "text", F.lit("[Utility:5]</s>"))).alias("t"))


@query(None)
def fix_spacing(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fix_spacing(F.replace("text", F.lit(". "), F.lit("."))).alias("t"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'True' WHEN 3 THEN 'answer B or D' ELSE 'none' END AS o, CASE WHEN p_partkey % 2 = 0 THEN 'fever' ELSE 'arc_c' END AS t FROM part)
SELECT p_partkey, CASE WHEN t = 'fever' AND lower(o) IN ('true', 'false') THEN lower(o) WHEN t = 'fever' AND o = 'SUPPORTS' THEN 'true' WHEN t = 'fever' AND o = 'REFUTES' THEN 'REFUTES'
 WHEN contains(o, 'D') THEN 'D' WHEN contains(o, 'C') THEN 'C' WHEN contains(o, 'B') THEN 'B' WHEN contains(o, 'A') THEN 'A' ELSE o END AS answer FROM x""")
def closed_answer(spark, d):
    k = F.col("p_partkey") % 5
    o = F.when(k == 0, "SUPPORTS").when(k == 1, "REFUTES").when(k == 2, "True").when(k == 3, "answer B or D").otherwise("none")
    task = F.when(F.col("p_partkey") % 2 == 0, "fever").otherwise("arc_c")
    return table(spark, d, "part").select("p_partkey", tx.closed_answer(o, task, F.lit("A B C D")).alias("answer"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ' the ', ' [Retrieval]<paragraph>x y</paragraph> '), '\[.*?\]', '', 'g'), '<paragraph>.*?</paragraph>', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents""")
def clean_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_answer(F.replace("text", F.lit(" the "), F.lit(" [Retrieval]<paragraph>x y</paragraph> "))).alias("t"))


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda s: true)) AS n, md5(array_to_string(list_transform(l, lambda s: trim(s)), '|')) AS paragraphs_md5 FROM x""")
def extract_paragraphs(spark, d):
    marked = F.concat(F.lit("[Retrieval]<paragraph> "), F.replace("text", F.lit("\n"), F.lit(" </paragraph>[Relevant] <paragraph>")), F.lit("</paragraph>[Utility:5]"))
    return table(spark, d, "documents").select("doc_id", tx.paragraphs(marked).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("paragraphs_md5"))


@query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE trim(text) END AS question FROM benchmark""")
def question_key(spark, d):
    marked = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Plan it.\nQuestion:  "), "text", F.lit("Question: again")))
    return table(spark, d, "benchmark").select("item_id", tx.question_key(marked).alias("question"))


@query("SELECT item_id, '### Instruction:' || chr(10) || 'Answer.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM benchmark")
def prompt_format(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.format_string("### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:\n", F.lit("Answer."), "text").alias("prompt"))


@query("""WITH l AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, p_partkey) AS t, list(p_type ORDER BY l_linenumber, p_partkey) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(range(1, least(len(t), 3) + 1), lambda i: '[' || i || '] ' || t[i] || chr(10) || x[i]), chr(10)) AS block FROM l""")
def evidence_block(spark, d):
    facts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    docs = facts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name", "p_type"))).alias("c"))
    return docs.select("l_orderkey", tx.evidence_block(F.col("c.p_name"), F.col("c.p_type"), 3).alias("block"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 'key' || s_suppkey END, CASE WHEN s_suppkey % 4 = 1 THEN 'first' END, CASE WHEN s_suppkey % 4 = 2 THEN s_name END, 'output') AS gold FROM supplier""")
def gold_coalesce(spark, d):
    k = F.col("s_suppkey") % 4
    possible = F.from_json(F.when(k == 1, '["first", "second"]'), "array<string>")
    gold = F.coalesce(F.when(k == 0, F.concat(F.lit("key"), F.col("s_suppkey").cast("string"))), F.get(possible, F.lit(0)), F.when(k == 2, F.col("s_name")), F.lit("output"))
    return table(spark, d, "supplier").select("s_suppkey", gold.alias("gold"))


@query("""WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations WHERE length(text) > 0)
SELECT conv_id, md5(string_agg(left(text, greatest(length(text) - 1, 0)) || ' [' || i || ']. ', '' ORDER BY turn)) AS answer_md5 FROM x GROUP BY conv_id""")
def citation_join(spark, d):
    x = table(spark, d, "conversations").where("length(text) > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda s, i: F.concat(F.substring(s["text"], F.lit(1), F.length(s["text"]) - 1), F.lit(" ["), i.cast("string"), F.lit("]. "))), "")
    return x.select("conv_id", F.md5(joined).alias("answer_md5"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN event_type ELSE '["' || event_type END AS first, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END::BIGINT AS n, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'y' ELSE 'b' END AS last FROM events""")
def json_or_csv(spark, d):
    """A list of any length, names between commas, and a list that is cut off."""
    k = F.col("event_id") % 3
    reply = F.when(k == 0, ' ["a", "b", "c", "d"]').when(k == 1, F.concat(F.lit(" "), "event_type", F.lit(" ,x, y ,z"))).otherwise(F.concat(F.lit('["'), "event_type", F.lit(", b")))
    c = table(spark, d, "events").select("event_id", tx.candidates(reply).alias("c"))
    return c.select("event_id", F.get("c", F.lit(0)).alias("first"), F.size("c").cast("long").alias("n"), F.try_element_at("c", F.lit(-1)).alias("last"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END, event_type) AS answer FROM events""")
def json_fallback(spark, d):
    reply = F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise("not json")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(reply, "$.k"), "event_type").alias("answer"))


@query("SELECT event_id, list_sum(map_values(map {'k': json_extract(props, '$.k')::BIGINT}))::BIGINT AS total FROM events")
def json_map_values(spark, d):
    return table(spark, d, "events").select("event_id", F.aggregate(F.map_values(F.from_json("props", "map<string,bigint>")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT p_partkey, chr(10) || 'A: ' || p_name || chr(10) || 'B: ' || p_brand || chr(10) || 'C: ' || p_type || chr(10) || 'D: ' || CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE '' END AS block FROM part""")
def arc_choices(spark, d):
    even = F.col("p_partkey") % 2 == 0
    labels = F.when(even, F.array(*map(F.lit, "1234"))).otherwise(F.array(*map(F.lit, "ABC")))
    texts = F.when(even, F.array("p_name", "p_brand", "p_type", F.lit("size"))).otherwise(F.array("p_name", "p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", tx.arc_choices(labels, texts).alias("block"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '[Long Form] Question: ' || text WHEN conv_id % 3 = 1 THEN 'Choose: ' || text ELSE text END AS prompt FROM conversations WHERE role = 'user'""")
def prompt_rewrite(spark, d):
    k = F.col("conv_id") % 3
    raw = F.concat("text", F.lit("</s>"))
    clean = F.replace(raw, F.lit("</s>"), F.lit(""))
    prompt = F.when(k == 0, F.concat(F.lit("[Long Form] Question: "), clean)).when(k == 1, F.concat(F.lit("Choose: "), clean)).otherwise(clean)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", prompt.alias("prompt"))


#: Accepted wordings of the three claim labels.
LABEL_SYNONYMS = {
    "REFUTES": ["refutes", "refute", "false", "incorrect", "not accurate", "not true", "not correct", "does not make sense", "not entirely accurate", "incomplete"],
    "SUPPORTS": ["supports", "support", "true", "correct"],
    "NOT ENOUGH INFO": ["not enough information", "not enough info"]}


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'supports|support|true|correct' WHEN toxic = 1 THEN 'refutes|refute|false|incorrect|not accurate|not true|not correct|does not make sense|not entirely accurate|incomplete' ELSE 'not enough information|not enough info' END AS synonyms FROM labels""")
def label_synonym_lookup(spark, d):
    names = spark.createDataFrame(list(LABEL_SYNONYMS.items()), "label string, synonyms array<string>")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS").when(F.col("toxic") == 1, "REFUTES").otherwise("NOT ENOUGH INFO")
    return table(spark, d, "labels").withColumn("label", label).join(F.broadcast(names), "label").select("doc_id", F.array_join("synonyms", "|").alias("synonyms"))


@query("""WITH x AS (SELECT conv_id, list(text ORDER BY turn) AS c FROM conversations GROUP BY conv_id) SELECT conv_id, least(len(c), 5) AS n, md5(array_to_string(c[1:5], '|')) AS context_md5 FROM x""")
def topn_context_slice(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    x = x.select("conv_id", F.transform(F.slice("c", 1, 5), lambda s: s["text"]).alias("c"))
    return x.select("conv_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("context_md5"))


@query("""WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS t, conv_id % 3 AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, trim(CASE WHEN k = 0 THEN t || ' and why is it?' ELSE t || '?' END) AS q FROM x WHERE k < 2 AND length(trim(CASE WHEN k = 0 THEN t || ' and why is it?' ELSE t || '?' END)) > 10""")
def subquery_valid(spark, d):
    k = F.col("conv_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('"'), "text", F.lit(' and why is it?" '))).when(k == 1, F.concat("text", F.lit("?"))).otherwise(F.regexp_replace("text", r"\?", ""))
    q = tx.strip(F.btrim(tx.strip(raw), F.lit('"')))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q")).where((F.length("q") > 10) & F.contains("q", F.lit("?")))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS q FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S')")
def valid_queries(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", tx.strip(F.col("text")).alias("q")).where("q <> ''")


@query("""WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[SUFFICIENT]' WHEN 1 THEN 'No_Retrieval: ' ELSE '[SUBQ] ' || text END AS o FROM conversations) SELECT conv_id, turn, contains(lower(o), 'no_retrieval') OR contains(lower(o), 'sufficient') AS stop FROM x""")
def planner_stop(spark, d):
    o = F.when(F.col("turn") % 3 == 0, "[SUFFICIENT]").when(F.col("turn") % 3 == 1, "No_Retrieval: ").otherwise(F.concat(F.lit("[SUBQ] "), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_like(F.lower(o), F.lit("no_retrieval|sufficient")).alias("stop"))


@query("""WITH x AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT count(*) AS n, count(*) FILTER (NOT contains(t, 'apolo') AND NOT contains(t, 'the information')) AS kept FROM x""")
def eval_skip_refusals(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.contains(t, F.lit("apolo")) & ~F.contains(t, F.lit("the information"))).alias("kept"))


@query("SELECT doc_id, string_split(text || '</s>tail', '</s>')[1] AS prediction FROM documents")
def cut_at_eos(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split_part(F.concat("text", F.lit("</s>tail")), F.lit("</s>"), F.lit(1)).alias("prediction"))


@query("SELECT item_id, coalesce(CASE WHEN item_id % 2 = 0 THEN 'do ' || item_id END, text) AS instruction FROM benchmark")
def instruction_coalesce(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.coalesce(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("do "), F.col("item_id").cast("string"))), F.col("text")).alias("instruction"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'SINGLE: ' || text ELSE 'MULTIPLE: ' || replace(text, '. ', '?|') END AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(reply, 'SINGLE') THEN 'single' ELSE 'multiple' END AS kind, CASE WHEN starts_with(reply, 'SINGLE') THEN 1 ELSE least(3, len(list_filter(string_split(split_part(reply, ': ', 2), '|'), lambda x: x <> ''))) END::BIGINT AS n FROM r""")
def response_parse(spark, d):
    """Replies with one question, or with one a sentence, of which as many count as there are documents."""
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("SINGLE: "), "text")).otherwise(F.concat(F.lit("MULTIPLE: "), F.replace("text", F.lit(". "), F.lit("?|"))))
    parts = F.filter(F.split(F.split_part(reply, F.lit(": "), F.lit(2)), r"\|"), lambda x: x != "")
    docs = F.array(F.lit("d1"), F.lit("d2"), F.lit("d3"))
    zipped = F.filter(F.arrays_zip(parts.alias("q"), docs.alias("d")), lambda p: p["q"].isNotNull() & p["d"].isNotNull())
    single = F.startswith(reply, F.lit("SINGLE"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(single, "single").otherwise("multiple").alias("kind"), F.when(single, 1).otherwise(F.size(zipped)).cast("long").alias("n"))


# Triples: one for each line of an order.

TRIPLES = """(SELECT l_orderkey, l_linenumber, l_partkey, '(S> ' || p_name || '| P> supplied by| O> ' || s_name || ')' AS t, p_name AS s, 'supplied by' AS p, s_name AS o
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _lines(spark, d):
    """No fewer than there are triples; read from the files' footers."""
    return table(spark, d, "lineitem").count()


def triples(spark, d):
    facts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return facts.select("l_orderkey", "l_linenumber", "l_partkey", tr.triple(F.col("p_name"), F.lit("supplied by"), F.col("s_name")).alias("t"))


def triple_lists(spark, d):
    return triples(spark, d).repartition(tr.tasks(_lines(spark, d)), "l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"]).alias("ts"))


@query(f"SELECT l_orderkey, count(*) AS n, min(t) AS first FROM {TRIPLES} GROUP BY l_orderkey")
def triple_split(spark, d):
    return triple_lists(spark, d).select("l_orderkey", F.explode(tr.split(tr.join(F.col("ts")))).alias("t")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))


@query(f"SELECT l_orderkey, string_agg(t, ', ' ORDER BY l_linenumber, t) AS text FROM {TRIPLES} GROUP BY l_orderkey")
def triple_join(spark, d):
    return triple_lists(spark, d).select("l_orderkey", tr.join(F.col("ts")).alias("text"))


@query(f"SELECT l_orderkey, l_linenumber, s AS subject, p AS predicate, o AS object FROM {TRIPLES}")
def triple_parse(spark, d):
    return triples(spark, d).select("l_orderkey", "l_linenumber", tr.parse(F.col("t")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query(f"SELECT l_orderkey, unnest(list_transform(regexp_extract_all(string_agg(t, ', ' ORDER BY l_linenumber, t), '\\((.*?)\\)', 1), lambda x: x)) AS inner_text FROM {TRIPLES} GROUP BY l_orderkey")
def triple_extract(spark, d):
    return triple_lists(spark, d).select("l_orderkey", F.explode(tr.extract(tr.join(F.col("ts")))).alias("inner_text"))


@query(f"SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS valid FROM {TRIPLES}")
def triple_valid(spark, d):
    t = F.when(F.col("l_linenumber") % 2 == 0, F.col("t")).otherwise(F.replace("t", F.lit("O>"), F.lit("P>")))
    return triples(spark, d).select("l_orderkey", "l_linenumber", tr.is_valid(t).alias("valid"))


@query(f"SELECT l_orderkey, l_linenumber, '(S> ' || s || '| P> ' || p || '| O> ' || unnest([o, 'other']) || ')' AS t FROM {TRIPLES}")
def triple_multi_object(spark, d):
    two = F.concat(F.regexp_replace("t", r"\)$", ""), F.lit("| O> other)"))
    return triples(spark, d).select("l_orderkey", "l_linenumber", F.explode(tr.expand_objects(two)).alias("t"))


@query(f"SELECT l_partkey, max_by(t, (l_orderkey, l_linenumber, t)) AS t FROM {TRIPLES} GROUP BY l_partkey")
def triples_lookup(spark, d):
    return triples(spark, d).groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "t")).alias("x")).select("l_partkey", "x.t")


@query(f"SELECT count(*) AS total, count(*) FILTER (l_linenumber % 3 = 0) AS as_is, count(*) FILTER (l_linenumber % 3 = 1) AS expanded, count(*) FILTER (l_linenumber % 3 = 2) AS to_model FROM {TRIPLES}")
def triple_format_stats(spark, d):
    k = F.col("l_linenumber") % 3
    t = F.when(k == 0, F.col("t")).when(k == 1, F.concat(F.regexp_replace("t", r"\)$", ""), F.lit("| O> other)"))).otherwise(F.replace("t", F.lit("S>"), F.lit("")))
    kind = F.when(tr.is_valid(t), "as_is").when(F.contains(t, F.lit("S>")) & F.contains(t, F.lit("P>")) & F.contains(t, F.lit("O>")), "expanded").otherwise("to_model")
    return triples(spark, d).select(kind.alias("k")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("k") == x).alias(x) for x in ("as_is", "expanded", "to_model")])


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'modified' ELSE 'unchanged' END AS flag FROM {TRIPLES}")
def modification_flag(spark, d):
    new = F.when(F.col("l_linenumber") % 4 == 0, F.lower("t")).otherwise(F.col("t"))
    return triples(spark, d).select("l_orderkey", "l_linenumber", F.when(new != F.col("t"), "modified").otherwise("unchanged").alias("flag"))


def _graphs(spark, d):
    return tr.graphs(triples(spark, d), "l_orderkey", "t", _lines(spark, d))


@query(f"SELECT l_orderkey, count(*) AS triples, bool_and(l_linenumber % 5 <> 0) AS has_graph FROM {TRIPLES} GROUP BY l_orderkey")
def graph_failures(spark, d):
    """Every fifth triple of an order has lost its object: its order has no graph, the others keep theirs."""
    t = F.when(F.col("l_linenumber") % 5 == 0, F.regexp_replace("t", r"\| O>.*$", ")")).otherwise(F.col("t"))
    some = triples(spark, d).select("l_orderkey", t.alias("t"))
    whole = tr.graphs(some, "l_orderkey", "t", _lines(spark, d)).select("l_orderkey", F.lit(True).alias("whole"))
    counts = some.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("triples"))
    return counts.join(whole, "l_orderkey", "left").select("l_orderkey", "triples", F.coalesce("whole", F.lit(False)).alias("has_graph"))


NODES = f"(SELECT l_orderkey, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY name) - 1 AS node_idx FROM (SELECT DISTINCT l_orderkey, unnest([s, o]) AS name FROM {TRIPLES}))"


@query(f"SELECT l_orderkey, name, node_idx FROM {NODES}")
def graph_nodes(spark, d):
    return _graphs(spark, d).select("l_orderkey", F.posexplode("names").alias("node_idx", "name")).select("l_orderkey", "name", "node_idx")


EDGES = f"""(SELECT e.l_orderkey, a.node_idx AS src, b.node_idx AS dst, e.p AS predicate FROM (SELECT l_orderkey, s, p, o FROM {TRIPLES} UNION ALL SELECT l_orderkey, o, 'inverse_' || p, s FROM {TRIPLES}) e
JOIN {NODES} a ON a.l_orderkey = e.l_orderkey AND a.name = e.s JOIN {NODES} b ON b.l_orderkey = e.l_orderkey AND b.name = e.o)"""


def _edges(spark, d):
    return tr.edges(_graphs(spark, d), "l_orderkey")


@query(f"SELECT * FROM {EDGES}")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"SELECT l_orderkey, dst AS node_idx, round(avg(src), 6) AS mean_neighbor, count(*) AS n FROM {EDGES} GROUP BY l_orderkey, dst")
def neighbor_mean(spark, d):
    return tr.neighbor_means(_graphs(spark, d), "l_orderkey").select("l_orderkey", "node_idx", F.round("mean", 6).alias("mean_neighbor"), "n")
