"""Corpus alignment, splitting, sampling and incremental queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import sources, streaming
from lodestone.functions import vectors as vx
from lodestone.operators import corpora, rows
from lodestone.plans.registry import query
from lodestone.sources.batches import IndexBuild
from lodestone.tables import scratch, table


def _new_old(spark, d):
    """New corpus: even documents; old corpus: all."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    return docs.where("idx % 2 = 0"), docs


@query("SELECT o.doc_id AS old_idx, n.new_idx FROM documents o JOIN (SELECT text, max(doc_id) AS new_idx FROM documents WHERE doc_id % 2 = 0 GROUP BY text) n USING (text)")
def corpus_index_map(spark, d):
    return corpora.index_map(*_new_old(spark, d))


@query("""SELECT doc_id, CASE WHEN v.vec_id IS NULL THEN 0 ELSE 64 END::BIGINT AS nonzero_dims, round(coalesce(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE)), 0), 6) AS total
FROM documents LEFT JOIN embeddings v ON v.vec_id = doc_id""")
def vector_gather_left(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = corpora.gather(table(spark, d, "documents").select("doc_id"), old, "doc_id", "embedding", 64)
    return out.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero_dims"), F.round(vx.total(F.col("embedding")), 6).alias("total"))


@query("SELECT md5(text) AS text_md5 FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT text FROM documents WHERE length(text) > 50)")
def corpus_intersect(spark, d):
    docs = table(spark, d, "documents")
    part = lambda c: docs.where(c).select(F.md5("text").alias("text_md5"))
    return part("doc_id % 2 = 0").intersect(part("doc_id % 3 = 0")).intersect(part("length(text) > 50"))


@query("SELECT doc_id AS theme_id, dense_id FROM documents JOIN (SELECT text, max(doc_id) AS dense_id FROM documents WHERE doc_id % 2 = 1 GROUP BY text) USING (text) WHERE doc_id % 2 = 0")
def theme_dense_align(spark, d):
    """Of texts that repeat in the dense index the last position counts, so a theme id has one dense id."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pairs = corpora.text_map(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
    return pairs.select(F.col("left_id").alias("theme_id"), F.col("right_id").alias("dense_id"))


@query("SELECT dense_id, max(doc_id) AS theme_id FROM documents JOIN (SELECT text, max(doc_id) AS dense_id FROM documents WHERE doc_id % 2 = 1 GROUP BY text) USING (text) WHERE doc_id % 2 = 0 GROUP BY dense_id")
def dense_theme_align(spark, d):
    """The same map backwards: of theme ids with one dense id the last counts."""
    return theme_dense_align(spark, d).groupBy("dense_id").agg(F.max("theme_id").alias("theme_id"))


@query("SELECT count(*) AS n_texts, (SELECT count(*) FROM documents) = count(*) AS aligned FROM documents")
def assert_alignment(spark, d):
    docs = table(spark, d, "documents")
    sizes = docs.agg(F.count("doc_id").alias("ids"), F.count("text").alias("texts"))
    return sizes.select(F.col("texts").alias("n_texts"), F.when(F.col("ids") == F.col("texts"), True).otherwise(F.raise_error(F.lit("index and texts differ in number")).cast("boolean")).alias("aligned"))


@query("SELECT count(*) AS n_unique, max(c) AS most, round(avg(c), 6) AS mean FROM (SELECT count(*) AS c FROM documents GROUP BY text)")
def duplicate_stats(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("text_md5")).count().agg(F.count(F.lit(1)).alias("n_unique"), F.max("count").alias("most"), F.round(F.avg("count"), 6).alias("mean"))


@query("SELECT doc_id, f.first AS value FROM documents JOIN (SELECT text, min_by(doc_id, (doc_id % 7, doc_id)) AS first FROM documents GROUP BY text) f USING (text)")
def dedup_replicate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    values = docs.select("text", F.col("doc_id").alias("value"), (F.col("doc_id") % 7).alias("file"), F.col("doc_id").alias("pos"))
    return corpora.dedup_replicate(values, docs, "text", "value", "file", "pos").select("doc_id", "value")


@query("SELECT md5(text) AS text_md5, row_number() OVER (ORDER BY first) - 1 AS number FROM (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)")
def distinct_first_seen(spark, d):
    first = table(spark, d, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("first"))
    return rows.number(first, "first", name="number").select("text_md5", "number")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) - 1 AS pos FROM documents")
def row_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id").withColumn("place", rows.hash_order(F.col("doc_id"), 1))
    return rows.number(docs, "place", "doc_id").select("doc_id", "pos")


SPLIT = """WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE {} FROM x"""


@query(SPLIT.format("WHEN p < floor(n * 0.98::DOUBLE) THEN 'train' WHEN p < floor(n * 0.99::DOUBLE) THEN 'val' ELSE 'test' END AS split"))
def split_98_1_1(spark, d):
    return rows.split_by_shares(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.98, "val": 0.01, "test": 0.01})


@query(SPLIT.format("WHEN p < floor(n * 0.98::DOUBLE) THEN 'train' ELSE 'test' END AS split"))
def split_98_2(spark, d):
    return rows.split_by_shares(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.98, "test": 0.02})


@query("SELECT doc_id, CASE WHEN pos < n - ceil(n * 0.1::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM labels)")
def split_90_10(spark, d):
    """The labelled documents in a seeded order, a tenth (rounded up) held out for tests."""
    return rows.split_by_shares(table(spark, d, "labels").select("doc_id"), "doc_id", {"train": 0.9, "test": 0.1})


CHUNKS = "SELECT doc_id, least(floor(p / greatest(1, n // 5)), 4)::INT AS split_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)"


def _chunks(docs):
    placed = rows.number(docs.select("doc_id").withColumn("place", rows.hash_order(F.col("doc_id"), 7)), "place", "doc_id")
    return placed.select("doc_id", rows.chunk(F.col("pos"), docs.count(), 5).alias("split_id"))


@query(CHUNKS)
def split_k_chunks(spark, d):
    return _chunks(table(spark, d, "documents"))


@query(f"WITH s AS ({CHUNKS}), t AS (SELECT text, min(split_id) AS split_id FROM s JOIN documents USING (doc_id) GROUP BY text) SELECT doc_id, split_id FROM documents JOIN t USING (text) WHERE doc_id % 2 = 0")
def split_follow(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    by_text = corpora.keyed(docs, "text", "doc_id").join(_chunks(docs), "doc_id").groupBy("_k1", "_k2").agg(F.min("split_id").alias("split_id"))
    return corpora.keyed(docs.where("doc_id % 2 = 0"), "text", "doc_id").join(by_text, ["_k1", "_k2"]).select("doc_id", "split_id")


@query("SELECT doc_id, least(p // greatest(1, n // 4), 3)::INT AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)")
def range_shard(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return rows.number(docs, "doc_id").select("doc_id", rows.chunk(F.col("pos"), docs.count(), 4).alias("shard"))


@query("SELECT doc_id, (p // ceil(n / 12.0)::BIGINT)::INT AS chunk FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)")
def ceil_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    size = max(1, -(-docs.count() // 12))
    return rows.number(docs, "doc_id").select("doc_id", F.expr(f"cast(pos div {size} as int)").alias("chunk"))


@query("""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, (SELECT count(*) FROM (SELECT unnest([0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])::DOUBLE AS f) WHERE floor(f * n) <= p)::INT AS chunk FROM x""")
def progress_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    ends = [int(f * n) for f in [0.01, *[k / 20 for k in range(1, 21)]]]
    return rows.number(docs, "doc_id").select("doc_id", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("pos"))).alias("chunk"))


@query("""WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:' || conv_id || ':' || turn)) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn FROM x WHERE r <= floor(n * 0.5::DOUBLE)""")
def sample_array_fraction(spark, d):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(rows.hash_order(key).alias("place"), "turn"))).alias("t"))
    return lists.select("conv_id", F.explode(F.slice("t", F.lit(1), F.floor(F.size("t") * F.lit(0.5)).cast("int"))).alias("x")).select("conv_id", "x.turn")


@query("""SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings ORDER BY md5('42:' || vec_id) LIMIT 5""")
def verify_sample(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    sample = e.select("vec_id").orderBy(rows.hash_order(F.col("vec_id"))).limit(5)
    other = e.select("vec_id", F.col("embedding").alias("again"))
    return e.join(F.broadcast(sample), "vec_id").join(other, "vec_id").select("vec_id", F.round(vx.dot(F.col("embedding"), F.col("again")), 6).alias("dot"))


@query("SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def union_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("source"), "text")
    return a.unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), "text")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT user_id, max(value) AS v FROM events WHERE event_type <> 'click' GROUP BY user_id), n AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.user_id = n.user_id""")
def upsert_merge(spark, d):
    e = table(spark, d, "events")
    part = lambda c: e.where(c).groupBy("user_id").agg(F.max("value").alias("v"))
    return corpora.upsert(part("event_type <> 'click'"), part("event_type = 'click'"), "user_id", "v")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def resume_anti_join(spark, d):
    e = table(spark, d, "events")
    return corpora.missing(e, e.where("event_type = 'view'"), "event_id").select("event_id", "user_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return corpora.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'reprocess' ELSE 'keep' END AS state FROM embeddings")
def zero_vector_reprocess(spark, d):
    v = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.when(F.forall(v, lambda x: x == 0), "reprocess").otherwise("keep").alias("state"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0")
def nonzero_vectors(spark, d):
    v = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").where(vx.norm(v) > 1e-8).select("vec_id")


@query("SELECT count(*) AS n_vectors, min(len(embedding))::BIGINT AS dim, 'ip' AS metric FROM embeddings")
def index_metadata(spark, d):
    """What an index that has been written says of itself."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return sources.write_index(vectors, scratch(spark, "index")).select("n_vectors", F.col("dim").cast("long").alias("dim"), "metric")


def _build(spark, d):
    """An index of four batches whose run stops after two, meets one of these again, and goes on."""
    build = IndexBuild(spark, scratch(spark, "index"), 4)
    build.stage(table(spark, d, "embeddings").select("vec_id", "embedding"))
    build.run([0, 2])
    build.commit(build.attempt(0))
    build.run()
    return build


@query("SELECT count(*) AS n_vectors, max(len(embedding))::INT AS dim, 4::BIGINT AS n_batches, true AS complete FROM embeddings")
def index_batches(spark, d):
    return _build(spark, d).metadata()


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda y: y / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS u FROM x)
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, round(u[1], 5) AS first, round(list_sum(u), 4) AS total FROM u""")
def index_published(spark, d):
    """The rows of the built index in order, with their positions."""
    out = _build(spark, d).publish(scratch(spark, "published"))
    return out.select("pos", "vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(vx.total(F.col("embedding")), 4).alias("total"))


@query("SELECT event_id, event_type FROM events")
def stream_files_dedup(spark, d):
    return streaming.files_once(spark, f"{d}/events.parquet", ["event_id"]).select("event_id", "event_type")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling_windows(spark, d):
    return streaming.tumbling(spark, f"{d}/events.parquet", "1 hour").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT time_bucket(INTERVAL 20 MINUTE, ts) - k * INTERVAL 20 MINUTE AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(3) t(k) GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    """Windows of an hour every twenty minutes, so each event is in three."""
    return streaming.tumbling(spark, f"{d}/events.parquet", "1 hour", "20 minutes").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    return streaming.to_the_end(streaming.read(spark, f"{d}/events.parquet"), lambda stream: streaming.sessions(stream, "user_id", "30 minutes"))


def _deliveries(spark, d):
    """Events as they come in four files: the second repeats a day of the first, the third is the second once more, and
    the last brings some rows of the first days that were held back, too late."""
    folder, e = scratch(spark, "deliveries"), table(spark, d, "events")
    day, back = F.dayofmonth("ts"), (F.col("event_id") % 97 == 0) & (F.dayofmonth("ts") < 5)
    for name, rows in (("a", e.where((day < 10) & ~back)), ("b", e.where(day.between(9, 19) & ~back)), ("c", e.where(day.between(9, 19) & ~back)), ("d", e.where((day >= 20) | back))):
        rows.coalesce(1).write.parquet(f"{folder}/{name}")
    return folder


ON_TIME = "NOT (event_id % 97 = 0 AND day(ts) < 5)"


@query(f"SELECT event_id, user_id, event_type FROM events WHERE {ON_TIME}")
def stream_repeated_files(spark, d):
    """Each event once, though files and rows repeat; what comes too late is left out."""
    return streaming.files_once(spark, _deliveries(spark, d), ["event_id"], late="2 days", files=1).select("event_id", "user_id", "event_type")


@query(f"SELECT count(*) FILTER ({ON_TIME}) AS kept, count(*) FILTER (NOT ({ON_TIME})) AS late FROM events")
def stream_late_rows(spark, d):
    """How many rows were kept and how many came too late. Repeated rows are known and not late."""
    seen = []
    kept = streaming.files_once(spark, _deliveries(spark, d), ["event_id"], late="2 days", seen=seen, files=1)
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("late", F.lit(streaming.late_rows(seen)).cast("long"))


@query("""WITH x AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""WITH i AS (SELECT text, max(doc_id) AS new_idx FROM documents WHERE length(text) >= 50 GROUP BY text), m AS (SELECT o.doc_id AS old_idx, new_idx FROM documents o JOIN i USING (text)),
r AS (SELECT new_idx, min(old_idx) AS old_idx FROM m GROUP BY new_idx), x AS (SELECT *, row_number() OVER (ORDER BY new_idx) - 1 AS p, count(*) OVER () AS n FROM r)
SELECT p AS pos, new_idx, old_idx, coalesce(round(list_sum(embedding::DOUBLE[]), 6), 0) AS total, least(p // greatest(1, n // 5), 4)::INT AS split_id FROM x LEFT JOIN embeddings ON vec_id = old_idx""")
def pip_corpus_clean(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    first = corpora.index_map(docs.where("length(text) >= 50"), docs).groupBy("new_idx").agg(F.min("old_idx").alias("old_idx"))
    moved = rows.number(first, "new_idx")
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("old_idx"), "embedding")
    gathered = corpora.gather(moved, old, "old_idx", "embedding", 64)
    return gathered.select("pos", "new_idx", "old_idx", F.round(vx.total(F.col("embedding")), 6).alias("total"), rows.chunk(F.col("pos"), moved.count(), 5).alias("split_id"))


@query("""WITH v AS (SELECT d.doc_id, d.text FROM documents d JOIN embeddings e ON vec_id = doc_id WHERE vec_id % 10 <> 0), t AS (SELECT DISTINCT text FROM v WHERE text IN (SELECT text FROM documents WHERE doc_id % 3 > 0)),
x AS (SELECT text, row_number() OVER (ORDER BY md5('42:' || md5(text)), md5(text)) - 1 AS p, count(*) OVER () AS n FROM t) SELECT md5(text) AS text_md5, least(p // greatest(1, n // 5), 4)::INT AS split_id FROM x""")
def pip_aligned_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = table(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    dense = docs.join(e.where(vx.norm(v) > 1e-8).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.md5("text").alias("text_md5"))
    both = dense.intersect(docs.where("doc_id % 3 > 0").select(F.md5("text").alias("text_md5")))
    placed = rows.number(both.withColumn("place", rows.hash_order(F.col("text_md5"))), "place", "text_md5")
    return placed.select("text_md5", rows.chunk(F.col("pos"), placed.count(), 5).alias("split_id"))


@query("SELECT l_orderkey, l_linenumber, p_name AS doc FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name <> ''")
def flatten_supporting_docs(spark, d):
    facts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = facts.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list("p_name").alias("docs"))
    maps = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "docs"))).alias("m"))
    return maps.select("l_orderkey", F.explode("m").alias("l_linenumber", "docs")).select("l_orderkey", "l_linenumber", F.explode("docs").alias("doc")).where("doc <> ''")


@query("SELECT DISTINCT label FROM (SELECT p_brand AS label FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part)")
def distinct_labels(spark, d):
    return table(spark, d, "part").select(F.explode(F.array("p_brand", "p_type", "p_name")).alias("label")).distinct()


@query("""WITH l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT unnest([p_brand, p_type, p_name]) AS label FROM part))
SELECT p_partkey, list_sum(list_distinct([a.i, b.i, c.i]))::BIGINT AS positions, len(list_distinct([a.i, b.i, c.i]))::BIGINT AS ones FROM part JOIN l a ON p_brand = a.label JOIN l b ON p_type = b.label JOIN l c ON p_name = c.label""")
def label_multihot(spark, d):
    part = table(spark, d, "part")
    long = part.select("p_partkey", F.explode(F.array("p_brand", "p_type", "p_name")).alias("label"))
    numbered = rows.number(long.select("label").distinct(), "label", name="i")
    # A sparse vector: the positions that are 1. A dense one would be as long as the label dictionary, row by row.
    own = long.join(numbered, "label").groupBy("p_partkey").agg(F.array_sort(F.collect_set("i")).alias("on"))
    return own.select("p_partkey", F.aggregate("on", F.lit(0).cast("long"), lambda a, x: a + x).alias("positions"), F.size("on").cast("long").alias("ones"))
