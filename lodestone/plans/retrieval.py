"""Vector retrieval and distribution queries. Queries are the vectors whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import corpora, rows
from lodestone.operators import retrieval as rt
from lodestone.plans.registry import query
from lodestone.plans.texts import norm_sql
from lodestone.tables import materialize, table

SPLIT = "vec_id % 4"


def _vecs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label", F.expr(f"cast({SPLIT} as int)").alias("split_id"))


def _queries(vecs, *more):
    return vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), *more)


VECS = f"v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, ({SPLIT})::INT AS split_id FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0)"
DENSE = f"WITH {VECS}, s AS (SELECT query_id, vec_id, split_id, label, round(list_dot_product(v, q), 6) AS score FROM v, q)"
THEME = f"""WITH {VECS}, c1 AS (SELECT label, i, round(avg(v[i]), 6) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM c1 GROUP BY label),
t AS (SELECT vec_id, list(round(greatest(list_dot_product(v, c), 1e-15), 6) ORDER BY c.label) AS theme FROM v, c GROUP BY vec_id), w AS (SELECT v.*, theme FROM v JOIN t USING (vec_id)), qt AS (SELECT vec_id AS query_id, v AS q, theme AS qtheme FROM w WHERE vec_id % 50 = 0)"""


@query(f"{DENSE} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def dense_topk_ip(spark, d):
    vecs = _vecs(spark, d)
    return rt.topk(vecs, _queries(vecs), 10)


@query(f"{DENSE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10) SELECT query_id, vec_id, score FROM k JOIN documents ON doc_id = vec_id WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]') AND length(regexp_replace(text, '[A-Za-z0-9\\s]', '', 'g')) / length(text)::DOUBLE <= 0.3 AND length(trim(text)) >= 3")
def dense_topk_clean(spark, d):
    vecs = _vecs(spark, d)
    good = table(spark, d, "documents").where(tx.is_clean(F.col("text"))).select(F.col("doc_id").alias("vec_id"))
    return rt.topk(vecs, _queries(vecs), 10).join(good, "vec_id", "left_semi").select("query_id", "vec_id", "score")


@query(f"{DENSE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, split_id ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 10) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k QUALIFY rank <= 10")
def global_topk_merge(spark, d):
    vecs = _vecs(spark, d)
    return rt.best(rt.topk(vecs, _queries(vecs), 10, split_col="split_id").drop("rank"), 10, "query_id").select("query_id", "vec_id", "score", "rank")


def _themed(spark, d):
    vecs = rt.with_theme(_vecs(spark, d))
    return vecs, _queries(vecs, "theme")


def _scoped_sql(theme_score, theme_k, dense_k, k, w, keys):
    by = ", ".join(keys)
    return f"""{THEME}, a AS (SELECT query_id, vec_id, split_id, {theme_score} AS ts, v, q FROM w, qt QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, vec_id) <= {theme_k}),
b AS (SELECT *, round(list_dot_product(v, q), 6) AS ds FROM a QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ds DESC, vec_id) <= {dense_k}),
c2 AS (SELECT *, round({w}::DOUBLE * ds + {round(1 - w, 9)}::DOUBLE * ts, 8) AS score FROM b) SELECT {by}, vec_id, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, vec_id) AS rank FROM c2 QUALIFY rank <= {k}"""


IP_THEME = "round(list_dot_product(theme, qtheme), 6)"


@query(f"{THEME}, s AS (SELECT query_id, vec_id, round(0.8::DOUBLE * round(list_dot_product(v, q), 6) + 0.2::DOUBLE * {IP_THEME}, 8) AS score FROM w, qt) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def theme_scoped_topk(spark, d):
    """The best by vector and theme together, of all rows: no stage cuts before."""
    vecs, queries = _themed(spark, d)
    return rt.theme_scoped(vecs, queries, None, None, 10, 0.8)


@query(f"WITH z AS ({_scoped_sql(IP_THEME, 100, 50, 10, 0.8, ['query_id', 'split_id'])}) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def theme_scoped_splits(spark, d):
    vecs, queries = _themed(spark, d)
    return rt.best(rt.theme_scoped(vecs, queries, 100, 50, 10, 0.8, split_col="split_id").drop("rank"), 10, "query_id").select("query_id", "vec_id", "score", "rank")


@query(_scoped_sql(IP_THEME, 100_000, 20, 10, 0.9, ["query_id"]))
def theme_scoped_framework(spark, d):
    """With the question loop's parameters: 100,000 by theme, twice the result's size by vector, nine parts to one."""
    vecs, queries = _themed(spark, d)
    return rt.theme_scoped(vecs, queries, 100_000, 2 * 10, 10, 0.9)


L2_THEME = "round(-list_sum(list_transform(range(1, len(theme) + 1), lambda i: (theme[i] - qtheme[i]) * (theme[i] - qtheme[i]))), 6)"


@query(_scoped_sql(L2_THEME, 100, 50, 10, 0.9, ["query_id", "split_id"]))
def theme_scoped_l2(spark, d):
    vecs, queries = _themed(spark, d)
    return rt.theme_scoped(vecs, queries, 100, 50, 10, 0.9, metric="l2", split_col="split_id")


@query(f"{THEME} SELECT query_id, vec_id, {L2_THEME} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {L2_THEME} DESC, vec_id) AS rank FROM w, qt QUALIFY rank <= 10")
def theme_topk_l2(spark, d):
    vecs, queries = _themed(spark, d)
    return rt.topk(vecs.withColumn("v", F.col("theme")), queries.withColumn("q", F.col("theme")), 10, "l2")


@query(f"{THEME}, x AS (SELECT vec_id, unnest(range(0, len(theme))) AS i, unnest(theme) AS p FROM w) SELECT vec_id, i::INT AS theme_idx, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS rank FROM x QUALIFY rank <= 3")
def theme_topk(spark, d):
    top = rt.with_theme(_vecs(spark, d)).select("vec_id", F.posexplode(vx.top_positions(F.col("theme"), 3)).alias("k", "x"))
    return top.select("vec_id", F.col("x.i").alias("theme_idx"), F.col("x.p").alias("p"), (F.col("k") + 1).alias("rank"))


@query(f"{DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, r.label, min(rank) AS target_rank FROM r JOIN (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 50 = 0) t USING (query_id, label) WHERE r.vec_id <> query_id GROUP BY query_id, r.label")
def target_rank(spark, d):
    return _ranks(spark, d)


def _ranks(spark, d):
    """The rank of each query's best other vector of its label."""
    vecs = _vecs(spark, d)
    return rt.target_ranks(vecs, _queries(vecs, "label"))


RANKS = f"{DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), t AS (SELECT query_id, min(rank) AS k FROM r JOIN (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 50 = 0) t USING (query_id, label) WHERE r.vec_id <> query_id GROUP BY query_id)"


@query(f"{RANKS} SELECT round(avg(k), 6) AS mean_rank, round(avg((k <= 10)::INT), 6) AS success_10, round(avg((k <= 100)::INT), 6) AS success_100 FROM t")
def recall_at_k(spark, d):
    r = F.col("target_rank")
    return _ranks(spark, d).agg(F.round(F.avg(r), 6).alias("mean_rank"), F.round(F.avg((r <= 10).cast("int")), 6).alias("success_10"), F.round(F.avg((r <= 100).cast("int")), 6).alias("success_100"))


@query(f"{RANKS} SELECT a.query_id, a.k > 100 AND b.k > 100 AND c.k > 100 AS hard, b.k < a.k OR c.k < a.k AS better, b.k > a.k AND c.k > a.k AS worse FROM t a JOIN t b ON b.query_id = a.query_id + 50 JOIN t c ON c.query_id = a.query_id + 100")
def rank_case_studies(spark, d):
    ranks = materialize(_ranks(spark, d).select("query_id", F.col("target_rank").alias("k")), "ranks")
    sub = lambda k, name: ranks.select((F.col("query_id") - 50 * k).alias("query_id"), F.array("k").alias(name))
    a, b, c = F.col("k"), F.array_min("s1"), F.array_min("s2")
    every = F.concat(F.array("k"), "s1", "s2")
    return ranks.join(sub(1, "s1"), "query_id").join(sub(2, "s2"), "query_id").select("query_id", F.forall(every, lambda x: x > 100).alias("hard"), ((b < a) | (c < a)).alias("better"), ((b > a) & (c > a)).alias("worse"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.total(vx.normalized(F.col("embedding"))), 6).alias("total"))


DISTS = """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(abs(x)::DOUBLE, 1e-15), 1.0::DOUBLE)) AS c FROM embeddings), n AS (SELECT vec_id, list_transform(c, lambda x: x / list_sum(c)) AS p FROM p)"""


def _dists(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vx.distribution(F.transform("embedding", lambda x: F.abs(x))).alias("p"))


@query(f"{DISTS} SELECT vec_id, round(list_sum(p), 6) AS total, round(list_max(p), 6) AS most FROM n")
def dist_clip_renorm(spark, d):
    return _dists(spark, d).select("vec_id", F.round(vx.total(F.col("p")), 6).alias("total"), F.round(F.array_max("p"), 6).alias("most"))


@query(f"""{DISTS}, x AS (SELECT a.vec_id, a.p, b.p AS q, list_transform(range(1, 65), lambda i: (a.p[i] + b.p[i]) / 2) AS m FROM n a JOIN n b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sqrt(greatest((list_sum(list_transform(range(1, 65), lambda i: p[i] * ln(p[i] / m[i]))) + list_sum(list_transform(range(1, 65), lambda i: q[i] * ln(q[i] / m[i])))) / 2, 0)), 6) AS js,
 round(list_sum(list_transform(range(1, 65), lambda i: abs(list_sort(p)[i] - list_sort(q)[i]))) / 64, 6) AS wasserstein, round(list_sum(list_transform(range(1, 65), lambda i: abs(p[i] - q[i]))), 6) AS l1,
 round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i])))), 6) AS l2 FROM x""")
def dist_distances(spark, d):
    p = _dists(spark, d)
    x = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    p, q = F.col("p"), F.col("q")
    return x.select("vec_id", F.round(vx.jensen_shannon(p, q), 6).alias("js"), F.round(vx.wasserstein_values(p, q), 6).alias("wasserstein"), F.round(vx.l1(p, q), 6).alias("l1"), F.round(F.sqrt(vx.squared_l2(p, q)), 6).alias("l2"))


@query(f"{DISTS}, x AS (SELECT a.p, b.p AS q FROM n a JOIN n b ON b.vec_id = a.vec_id + 1) SELECT round(sum(list_sum(list_transform(range(1, 65), lambda i: q[i] * (ln(q[i]) - ln(p[i]))))) / count(*), 6) AS kl FROM x")
def kl_batchmean(spark, d):
    p = _dists(spark, d)
    x = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return x.agg(F.round(F.sum(vx.total(F.zip_with("q", "p", lambda t, o: t * (F.log(t) - F.log(o))))) / F.count(F.lit(1)), 6).alias("kl"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS most FROM e")
def softmax_theme(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(vx.softmax(F.col("embedding"))), 6).alias("most"))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS p, 1 / (1 + exp(-embedding[1]::DOUBLE)) > 0.5 AS on_ FROM embeddings")
def sigmoid(spark, d):
    p = vx.sigmoid(F.col("embedding")[0].cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(p, 6).alias("p"), (p > 0.5).alias("on_"))


@query("SELECT label, i AS position, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 3 > 0 GROUP BY label, i")
def masked_mean_pool(spark, d):
    c = rt.centroids(_vecs(spark, d).where("vec_id % 3 > 0"))
    return c.select("label", (F.col("position") + 1).cast("long").alias("position"), "value")


@query("WITH a AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) SELECT i AS position, round(avg(m), 8) AS value FROM a GROUP BY i")
def mean_of_means(spark, d):
    return rt.centroids(_vecs(spark, d)).groupBy((F.col("position") + 1).cast("long").alias("position")).agg(F.round(F.avg("value"), 8).alias("value"))


SOFT = f"""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e, split_part(text, '.', 1) AS p FROM embeddings JOIN documents ON doc_id = vec_id),
x AS (SELECT a.vec_id, contains({norm_sql('a.p')}, {norm_sql("string_split(b.p, ' ')[1]")}) AS hit, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM a JOIN a b ON b.vec_id = a.vec_id + 1)"""


@query(f"{SOFT} SELECT vec_id, hit OR c >= 0.63 AS ok, NOT hit AND c >= 0.63 AS by_vector FROM x")
def soft_match(spark, d):
    """The first sentence of a document against the first word of the next; where it is not a part, their vectors."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("p"))
    a = table(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.array(F.split_part("p", F.lit(" "), F.lit(1))).alias("golds"), F.array("embedding").alias("vectors"))
    ok, added = tx.soft_match(F.col("p"), F.col("golds"), F.col("embedding"), F.col("vectors"))
    return a.join(b, "vec_id").select("vec_id", ok.alias("ok"), added.alias("by_vector"))


@query(f"{DENSE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 5) SELECT query_id, list_max(list(score)) AS best, row_number() OVER (ORDER BY list_max(list(score)) DESC, query_id) - 1 AS pos FROM k GROUP BY query_id")
def order_by_array_max(spark, d):
    vecs = _vecs(spark, d)
    lists = rt.topk(vecs, _queries(vecs), 5).groupBy("query_id").agg(F.collect_list("score").alias("scores"))
    return rows.number(lists.select("query_id", F.array_max("scores").alias("best")).withColumn("down", -F.col("best")), "down", "query_id").select("query_id", "best", "pos")


def _hop_sql(n, seen):
    """Hop n: the best vector that the query has not seen, for queries whose last one scored too little."""
    return f"""h{n} AS (SELECT p.query_id, x.vec_id, {", ".join(f"p.v{i}" for i in range(1, n))}{", " if n > 1 else ""}x.vec_id AS v{n}, round(list_dot_product(x.v, y.v), 6) AS score FROM h{n - 1} p JOIN v y ON y.vec_id = p.vec_id CROSS JOIN v x
WHERE p.score < {ENOUGH} AND x.vec_id NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY round(list_dot_product(x.v, y.v), 6) DESC, x.vec_id) = 1)"""


#: A score that some hops reach and others do not.
ENOUGH = 0.9
HOPS = f"WITH {VECS}, h0 AS (SELECT query_id, query_id AS vec_id, -1e9::DOUBLE AS score FROM q), {_hop_sql(1, 'p.query_id')}, {_hop_sql(2, 'p.query_id, p.v1')}, {_hop_sql(3, 'p.query_id, p.v1, p.v2')}"


@query(f"{HOPS} SELECT query_id, 1 AS hop, vec_id FROM h1 UNION ALL SELECT query_id, 2, vec_id FROM h2 UNION ALL SELECT query_id, 3, vec_id FROM h3")
def iterative_hops(spark, d):
    from lodestone.plans.loop import hops

    vecs = _vecs(spark, d)
    return hops(vecs, _queries(vecs), 3, enough=ENOUGH)


@query(f"""WITH {VECS}, t AS (SELECT text, max(doc_id) AS dense_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 = 0 GROUP BY text), m AS (SELECT doc_id AS vec_id, dense_id FROM documents JOIN t USING (text)),
s AS (SELECT query_id, x.vec_id, dense_id, round(list_dot_product(x.v, q), 6) AS ts, round(list_dot_product(y.v, q), 6) AS ds FROM v x JOIN m ON m.vec_id = x.vec_id JOIN v y ON y.vec_id = dense_id, q),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, vec_id) <= 50)
SELECT query_id, dense_id, max(round(0.8::DOUBLE * ds + 0.2::DOUBLE * ts, 8)) AS score FROM a GROUP BY query_id, dense_id""")
def unsplit_scoped(spark, d):
    """Two indexes over texts, joined by the text: a theme hit is scored by the vector of the last equal text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    dense = docs.where("doc_id % 2 = 1 OR doc_id % 5 = 0")
    pairs = materialize(corpora.text_map(docs, dense).select(F.col("left_id").alias("vec_id"), F.col("right_id").alias("dense_id")), "pairs")
    vecs = _vecs(spark, d)
    inside = vecs.join(pairs, "vec_id").join(vecs.select(F.col("vec_id").alias("dense_id")), "dense_id", "left_semi")
    hits = rt.topk(inside.select("vec_id", "v"), _queries(vecs), 50).withColumnRenamed("score", "theme_score").join(pairs, "vec_id")
    scored = hits.join(vecs.select(F.col("vec_id").alias("dense_id"), "v"), "dense_id").join(_queries(vecs), "query_id")
    blend = F.round(0.8 * rt.dot(F.col("v"), F.col("q")) + F.lit(0.2) * F.col("theme_score"), 8)
    return scored.select("query_id", "dense_id", blend.alias("score")).groupBy("query_id", "dense_id").agg(F.max("score").alias("score"))
