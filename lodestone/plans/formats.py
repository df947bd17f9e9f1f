"""Tables through the engine's sinks and back through its sources, and calls that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import models
from lodestone.functions import vectors as vx
from lodestone.operators import corpora, rows
from lodestone.plans.registry import query
from lodestone.tables import scratch, table


@query("SELECT doc_id, text, source FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "lines")
    sources.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    return sources.read_any(spark, path, "doc_id long, text string, source string")


@query("SELECT 'json' AS kind, item_id, text FROM benchmark UNION ALL SELECT 'jsonl', item_id, text FROM benchmark")
def json_by_suffix(spark, d):
    """The same rows as one array and as lines, told apart by the path's suffix."""
    base, b = scratch(spark, "suffix"), table(spark, d, "benchmark").select("item_id", "text")
    sources.write_json(b, f"{base}/x.json", "item_id")
    sources.write_jsonl(b, f"{base}/x.jsonl")
    read = lambda kind: sources.read_any(spark, f"{base}/x.{kind}", "item_id long, text string").select(F.lit(kind).alias("kind"), "item_id", "text")
    return read("json").unionByName(read("jsonl"))


@query("SELECT item_id // 10 AS part, ord, item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY item_id // 10 ORDER BY item_id) - 1 AS ord FROM benchmark) WHERE ord < 4")
def columnar_questions(spark, d):
    """Test sets stored as parallel lists, ten questions a file, of which the first four are read."""
    path, b = scratch(spark, "columnar"), table(spark, d, "benchmark").withColumn("part", F.expr("item_id div 10"))
    lists = b.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x")).select("part", F.col("x.item_id").alias("question_id"), F.col("x.text").alias("question"))
    lists.write.partitionBy("part").json(path)
    read = sources.read_columnar(spark, path, "question_id array<bigint>, question array<string>", 4, by="part")
    return read.select(F.col("part").cast("long").alias("part"), F.col("ord").cast("long").alias("ord"), F.col("question_id").alias("item_id"), F.col("question").alias("text"))


@query("SELECT text, count(*) AS n FROM documents WHERE text <> '' GROUP BY text")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line breaks through CSV; empty ones are not written."""
    path = scratch(spark, "csv")
    odd = table(spark, d, "documents").select("text")
    sources.write_csv(odd, path)
    return sources.read_texts(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM labels WHERE doc_id % 5 <> 0")
def split_files(spark, d):
    """A dataset in folders of its splits, of which two are read; the third is not opened."""
    path, k = scratch(spark, "splits"), F.col("doc_id") % 5
    sources.write_splits(table(spark, d, "labels").select("doc_id", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split")), path, sample=5)
    return sources.read_splits(spark, path, ("train", "val", "absent"))


@query("""WITH x AS (SELECT vec_id, (vec_id % 4)::INT AS split_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 IN (1, 3))
SELECT vec_id, split_id, round(list_sum(v) / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END, 4) AS total FROM x""")
def index_by_split(spark, d):
    """An index in folders of its splits, unit vectors, of which two splits are read."""
    path = scratch(spark, "index")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.expr("cast(vec_id % 4 as int)").alias("split_id"))
    sources.write_index(e, path, split="split_id")
    return sources.read_index(spark, path, "split_id", [1, 3]).select("vec_id", "split_id", F.round(vx.total(F.col("embedding")), 4).alias("total"))


@query("SELECT 'd' || doc_id AS id, (doc_id % 2)::INT AS file, 2::BIGINT AS n, 'see ' || source || ' end' AS first, md5(trim(text)) AS text_md5 FROM documents WHERE trim(text) = trim(text, chr(9) || chr(10) || chr(13) || ' ')")
def article_dumps(spark, d):
    """Documents as compressed dumps of articles in two folders: paragraphs of sentences, with anchors."""
    base, docs = scratch(spark, "dumps"), table(spark, d, "documents").where("trim(text) = regexp_replace(text, '^[\\t\\n\\r ]+|[\\t\\n\\r ]+$', '')")
    anchor = F.array(F.lit("see "), F.concat(F.lit('<a href="u">'), "source", F.lit("</a>")), F.lit(" end"))
    half = F.floor(F.length("text") / 2).cast("int")
    sentences = F.array(F.left("text", half), F.substring(F.col("text"), half + 1, F.length("text")))
    whole = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.array(anchor, sentences).alias("text"))
    for k, name in enumerate(("AA", "AB")):
        whole.where(F.col("doc_id") % 2 == k).drop("doc_id").write.option("compression", "bzip2").json(f"{base}/{name}")
    p = F.col("paragraphs")
    return sources.read_articles(spark, base, batch="folder").select("id", "file", F.size(p).cast("long").alias("n"), p[0].alias("first"), F.md5(p[1]).alias("text_md5"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0)")
def unanswered_questions(spark, d):
    """Questions whose text is not among those that a first run has answered."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("question"))
    return corpora.missing(asked, asked.where("conv_id % 3 = 0"), "question").select("conv_id", "turn")


def refusing(texts: list[str]) -> list[str]:
    """A hook that fails for a batch with a prompt of an odd number of characters."""
    if any(len(t) % 2 for t in texts):
        raise RuntimeError("refused")
    return [f"(S> {len(t)}| P> of| O> {t[:1]})" for t in texts]


@query("SELECT doc_id, CASE WHEN length(text) % 2 = 1 THEN '' ELSE '(S> ' || length(text) || '| P> of| O> ' || substr(text, 1, 1) || ')' END AS triples FROM documents")
def replies_with_failures(spark, d):
    """Triples of each text by a hook that fails for some of them: those get an empty text, their neighbours do not."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return models.generate(docs, "text", refusing, "triples", fallback="").select("doc_id", "triples")


@query("""WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS p, count(*) OVER () AS n FROM embeddings WHERE list_dot_product(embedding, embedding) > 1e-16 AND vec_id % 10 <> 0)
SELECT vec_id, least(p // greatest(1, n // 7), 6)::INT AS chunk FROM x""")
def chunks_of_cleaned_index(spark, d):
    """The rows of an index that are left without zero vectors, shuffled and cut into seven chunks."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    clean = e.where(vx.norm(F.col("embedding")) > 1e-8).select("vec_id", rows.hash_order(F.col("vec_id")).alias("place"))
    placed = rows.number(clean, "place", "vec_id")
    return placed.select("vec_id", rows.chunk(F.col("pos"), placed.count(), 7).alias("chunk"))
