"""Operators: numbering and splits, corpora, retrieval, training sets, streams, sources, models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import models
from lodestone.operators import corpora, reasoning, retrieval, rows, trainset
from lodestone.operators.asof import asof


def test_number_and_split(spark):
    df = spark.range(1003).select(((F.col("id") * 7919) % 1003).alias("k")).repartition(7)
    got = rows.number(df, F.desc("k"), name="pos").collect()
    assert sorted((r.pos, r.k) for r in got) == [(i, 1002 - i) for i in range(1003)]
    split = rows.split_by_shares(df, "k", {"train": 0.98, "val": 0.01, "test": 0.01}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": int(1003 * 0.98), "val": int(1003 * 0.99) - int(1003 * 0.98), "test": 1003 - int(1003 * 0.99)}
    assert rows.number(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n,k,sizes", [(10, 5, [2, 2, 2, 2, 2]), (11, 5, [2, 2, 2, 2, 3]), (24, 5, [4, 4, 4, 4, 8]), (29, 5, [5, 5, 5, 5, 9]), (9, 5, [1, 1, 1, 1, 5]), (4, 5, [1, 1, 1, 1])])
def test_chunks(spark, n, k, sizes):
    got = spark.range(n).select(rows.chunk(F.col("id"), n, k).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in got] == sizes


def test_index_map_golden(spark):
    df = lambda *t: spark.createDataFrame(list(enumerate(t)), "idx long, text string")
    got = corpora.index_map(df("text1", "text2", "text3"), df("text1", "text4", "text2")).collect()
    assert {r.old_idx: r.new_idx for r in got} == {0: 0, 2: 1}
    assert {r.new_idx for r in corpora.index_map(df("a", "a"), df("a")).collect()} == {1}


def test_gather_upsert_latest(spark):
    new, old = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<float>")
    assert {r.k: r.v for r in corpora.gather(new, old, "k", "v", 2).collect()} == {0: [0, 0], 1: [1, 2], 2: [0, 0]}
    a, b = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (2, 2)], [(2, 9), (3, 3)]))
    assert {r.k: r.v for r in corpora.upsert(a, b, "k", "v").collect()} == {1: 1, 2: 9, 3: 3}
    assert {r.k for r in corpora.missing(a, b, "k").collect()} == {1}
    assert {r.v for r in corpora.latest(spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "k long, t long, v long"), "k", "t").collect()} == {4}
    rep = corpora.dedup_replicate(spark.createDataFrame([("x", 0, 1), ("x", 1, 2)], "t string, o long, v long"), spark.createDataFrame([("x",), ("x",)], "t string"), "t", "v", "o")
    assert [r.v for r in rep.collect()] == [1, 1]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_topk_equals_numpy(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    r = np.random.default_rng(1)
    v, q = r.normal(size=(200, 6)).round(1), r.normal(size=(7, 6)).round(1)
    vecs = spark.createDataFrame([(i, list(map(float, x)), i % 3) for i, x in enumerate(v)], "vec_id long, v array<double>, split_id int").repartition(5)
    queries = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(q)], "query_id long, q array<double>")
    s = q @ v.T if metric == "ip" else -((q[:, None] - v[None]) ** 2).sum(-1)
    s = s.round(6)
    got = {(x.query_id, x["rank"]): x.vec_id for x in retrieval.topk(vecs, queries, 4, metric).collect()}
    assert got == {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(np.lexsort((np.arange(200), -s[i]))[:4])}
    assert retrieval.topk(vecs, queries, 4, metric, "split_id").count() == 7 * 3 * 4
    assert retrieval.topk(vecs, queries.limit(0), 4).count() == 0 and retrieval.topk(vecs.limit(0), queries, 4).count() == 0
    assert retrieval.topk(vecs, queries, 999).count() == 7 * 200


def test_theme_fallback(spark):
    vecs = spark.createDataFrame([(i, [float(i), 1.0], [1.0, float(i % 2)]) for i in range(20)], "vec_id long, v array<double>, theme array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 0.0]), (1, [1.0, 0.0], [0.0, 1.0])], "query_id long, q array<double>, theme array<double>")
    got = {}
    for r in retrieval.theme_scoped(vecs, queries, 5, 5, 3, 0.8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [19, 18, 17], 1: [9, 7, 5]}


def test_trainset(spark):
    steps = spark.createDataFrame([(1, 0, "a", "q0"), (1, 1, "b", "q1"), (2, 0, "c", "q2")], "k long, p long, s string, q string")
    got = {(r.k, r.p): (r.input, r.label) for r in trainset.prefix_examples(steps, "k", "p", "s", "q").collect()}
    assert got == {(1, 0): ("a", "[SUBQ] q1"), (1, 1): ("a\nb", "[SUFFICIENT]"), (2, 0): ("c", "[SUFFICIENT]")}
    needs, have = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k long, t string"), spark.createDataFrame([("x",)], "t string")
    assert [r.k for r in trainset.complete_only(needs, have, "k", "t").collect()] == [2]
    docs = spark.createDataFrame([(1, 1, 0.9, 50), (1, 2, 0.8, 60), (1, 3, 0.7, 10)], "k long, d long, s double, n long")
    assert [r.d for r in trainset.pack(docs, "k", "s", "n", 100, "d").collect()] == [1]


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 3, 3)], "k string, t long, id long")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20), ("b", 4, 40)], "k string, t long, v long")
    assert {r.id: r.v for r in asof(left, right, "k", "t", "v").collect()} == {1: 50, 2: None, 3: None}


def test_stream_resumes(spark, tmp_path):
    from lodestone.streaming import drain, read, windows

    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    make = lambda i, name: spark.createDataFrame([(i, __import__("datetime").datetime(2024, 1, 1, i), "x", 1.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/raw{name}")
    def put(i):
        make(i, i)
        part = next((tmp_path / f"raw{i}").glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"events{i}.parquet")
    put(0)
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    run = lambda: drain(stream(), f"file://{tmp_path}/ck", f"file://{tmp_path}/out")
    assert run().count() == 1
    put(1)
    assert sorted(r.event_id for r in run().collect()) == [0, 1]
    assert drain(windows(read(spark, f"file://{tmp_path}/in/events1.parquet"), "1 hour")).count() == 0


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\nbad\n{"text": "y"}\n')
    assert sources.read_any(spark, f"{base}/a.jsonl", "text string").count() == 3 and sources.read_jsonl(spark, f"{base}/a.jsonl", drop_malformed=True).select("text").where("text IS NOT NULL").count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"question": ["q1", "q2"], "answer": ["a1", "a2"]}))
    assert [tuple(r) for r in sources.read_columnar(spark, f"{base}/c.json", "question array<string>, answer array<string>", 1).collect()] == [(0, "q1", "a1")]
    (tmp_path / "p.csv").write_text("text,label_0,label_1\nNA,0.5,NA\nz,0.1,0.2\n")
    assert {r.text: [round(x, 3) for x in r.theme] for r in sources.read_probabilities(spark, f"{base}/p.csv", 2).collect()} == {"[INVALID_TEXT]": [0.5, 0.0], "z": [0.1, 0.2]}
    (tmp_path / "t.jsonl").write_text('{"text": "x", "triplet": " (S> a| P> b| O> c) "}\n{"text": "y", "triplet": ["(S> d"]}\n{"text": "z"}\n{"triplet": "t"}\nbad\n{"text": "w", "triplet": " "}\n')
    assert [tuple(r) for r in sources.read_triplets(spark, f"{base}/t.jsonl").collect()] == [("x", "(S> a| P> b| O> c)"), ("y", '["(S> d"]')]
    import bz2

    (tmp_path / "AA").mkdir()
    (tmp_path / "AA" / "w.bz2").write_bytes(bz2.compress(json.dumps({"id": "1", "title": "T", "url": "u", "text": [["T"], ["a <a href=\"x\">b</a>", " c. "]]}).encode() + b"\nbroken\n"))
    assert [(r.paragraphs, r.file) for r in sources.read_articles(spark, f"{base}/AA").where("id IS NOT NULL").collect()] == [(["T", "a b c."], 0)]
    df = spark.createDataFrame([(1, 'say "hi"', [3.0, 4.0], "train"), (2, "", [0.0, 0.0], "val")], "id long, text string, embedding array<float>, split string")
    sources.write_csv(df.select("id", "text"), f"{base}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{base}/csv").first().text == 'say "hi"'
    assert tuple(sources.write_index(df, f"{base}/ix").first()) == (2, 2, "ip")
    sources.write_index(df, f"{base}/parts", split="split")
    part = sources.read_index(spark, f"{base}/parts", "split", ["val"])
    assert [r.id for r in part.collect()] == [2] and len(sources.read_index(spark, f"{base}/parts", "split").collect()) == 2
    assert all("split=val" in f for f in part.select("_metadata.file_path").distinct().toPandas()["file_path"])
    (tmp_path / "t.csv").write_text('id,text\n1,"a ""b"", c"\n')
    assert [r.text for r in sources.read_texts(spark, f"{base}/t.csv").collect()] == ['a "b", c']
    sources.write_splits(df, f"{base}/sp", sample=1)
    assert spark.read.json(f"{base}/sp_sample").count() == 1
    assert sources.read_splits(spark, f"{base}/sp", ("train",)).count() == 1
    sources.write_jsonl(df, f"{base}/js")
    assert sources.read_jsonl(spark, f"{base}/js", "id long").count() == 2


def test_models(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "id long, t string")
    assert {r.id: r.output for r in models.generate(df, "t", models.stub_triples).collect()} == {1: "(S> one| P> mentions| O> two)", 2: "(S> | P> mentions| O> )"}

    def broken(texts):
        raise RuntimeError

    assert {r.output for r in models.generate(df, "t", broken, fallback="none").collect()} == {"none"}
    assert all(abs(sum(x * x for x in r.embedding) - (1 if r.t else 0)) < 1e-5 for r in models.encode(df, "t", models.stub_vector(4)).collect())


def test_question_columns_are_bounded(spark):
    from lodestone.plans.training import question_columns

    rows = question_columns(spark.range(3500).selectExpr("id AS item_id", "concat('q', id) AS text")).collect()
    assert len(rows) == 4 and max(len(r.context) for r in rows) <= 1000
    assert sorted((q, c) for r in rows for q, c in zip(r.question, r.context)) == sorted((f"q{i}", i) for i in range(3500))


def test_ranks_take_every_query(spark, monkeypatch):
    from lodestone.plans.retrieval import target_rank

    monkeypatch.setattr(retrieval, "BLOCK", 5)
    assert target_rank(spark, "/root/testdata/sf0.001").select("query_id").distinct().count() == 10


def test_candidates_are_k_a_query_and_task(spark):
    """However many batches a task reads."""
    r = np.random.default_rng(2)
    vecs = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(r.normal(size=(900, 4)))], "vec_id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(r.normal(size=(5, 4)))], "query_id long, q array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert retrieval.candidates(vecs, queries, 10).count() == 5 * 3 * 10
        assert retrieval.candidates(vecs, queries, 10_000).count() == 5 * 900
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_target_ranks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, size=(120, 3)).astype(float)
    vecs = spark.createDataFrame([(i, list(x), f"l{i % 7}") for i, x in enumerate(v.tolist())] + [(999, None, "l0")], "vec_id long, v array<double>, label string").repartition(4)
    queries = vecs.where("vec_id % 11 = 0 AND vec_id < 120").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")
    queries = queries.unionByName(spark.createDataFrame([(500, [1.0, 0.0, 0.0], "none")], queries.schema))
    want = {}
    for i in range(0, 120, 11):
        order = np.lexsort((np.arange(120), -(v @ v[i])))
        want[i] = 1 + next(k for k, j in enumerate(order) if j != i and j % 7 == i % 7)
    assert {x.query_id: x.target_rank for x in retrieval.target_ranks(vecs, queries).collect()} == want


def test_hops_stop_and_move_on(spark):
    from lodestone.plans.loop import hops

    v = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.5, 2.0]), (3, [0.0, 3.0]), (50, [0.0, 0.1])]
    vecs = spark.createDataFrame([(i, x) for i, x in v], "vec_id long, v array<double>")
    queries = vecs.where("vec_id IN (0, 50)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = {(r.query_id, r.hop): r.vec_id for r in hops(vecs, queries, 3, enough=1.0).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (50, 1): 3, (50, 2): 2}


def test_select_docs(spark):
    replies = {1: "Docs 2 , 3 help, not 1", 2: "none", 3: "4", 4: "0,1", 5: "x1"}
    docs = spark.createDataFrame([(q, i * 10, replies[q]) for q in replies for i in range(3)], "q long, p long, reply string")
    got = sorted((r.q, r.p) for r in trainset.select_docs(docs, "q", "p", "reply").collect())
    assert got == [(1, 10), (1, 20), *[(3, 10 * i) for i in range(3)], *[(4, 10 * i) for i in range(3)], (5, 0)]


def test_text_map_takes_the_last(spark):
    df = lambda *t: spark.createDataFrame(list(t), "doc_id long, text string")
    got = corpora.text_map(df((1, "a"), (2, "a"), (3, "b"), (4, "c")), df((7, "a"), (9, "a"), (8, "b"), (6, "b"))).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(1, 9), (2, 9), (3, 8)]


def test_scratch_needs_shared_storage(spark):
    from lodestone import tables

    class Far:
        sparkContext = type("C", (), {"master": "yarn", "getCheckpointDir": lambda self: None})()
        conf = type("F", (), {"get": lambda self, *a: None})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Far())


def test_sub_queries(spark):
    def hook(prompts):
        if "broken" in prompts[0]:
            raise RuntimeError
        return [f'"Is it {prompts[0]}?"']

    docs = spark.createDataFrame([(1, 0, "long topic", "x"), (1, 1, "broken", None), (1, 2, None, "z"), (None, 0, "no key here", "y"), (2, 0, "t", "w")], "k long, p long, topic string, other string")
    got = {(r.k, r.p): (r.sub_query, r.is_fallback, r.other) for r in reasoning.sub_queries(docs, "k", ["p"], "topic", hook, lambda row, before: f"{row['topic']}/{len(before)}", tries=2).collect()}
    assert got == {
        (1, 0): ("Is it long topic/0?", False, "x"), (1, 1): ("What does this document tell us about broken?", True, None), (1, 2): ("Is it None/2?", False, "z"),
        (None, 0): ("Is it no key here/0?", False, "y"), (2, 0): ("What does this document tell us about t?", True, "w")}  # ten characters are too few
    assert reasoning.sub_queries(docs.limit(0), "k", ["p"], "topic", hook, lambda row, before: "").count() == 0


def test_answer_by_candidates(spark):
    replies = {"q1": '["a", "b"]', "q2": "c , d", "q3": "[]", "q4": '["a", 3'}

    def hook(prompts):
        return [replies[p[1:]] if p[0] == "?" else p.upper() if p[0] == "s" else '{"final_answer": "b"}' if "Candidate 'b'" in p else "{}" for p in prompts]

    items = spark.createDataFrame([(i, f"q{i}", "p") for i in range(1, 5)], "k long, q string, p string")
    got = reasoning.answer_by_candidates(items, "k", "q", "p", hook, lambda q: F.concat(F.lit("?"), q), lambda q, c, p: F.concat(F.lit("s"), q, c, p), lambda q, s: F.concat(F.lit("v"), q, s))
    assert {r.k: (r.candidates, r.summaries, r.output) for r in got.collect()} == {
        1: (["a", "b"], ["SQ1AP", "SQ1BP"], "b"), 2: (["c", "d"], ["SQ2CP", "SQ2DP"], "c"), 3: ([], [], None), 4: (['["a"', "3"], ['SQ4["A"P', "SQ43P"], '["a"')}


def test_intermediates_go_and_results_stay(spark):
    import os

    from lodestone.tables import intermediates, materialize, scratch

    place = lambda df: df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    out = scratch(spark, "out")
    with intermediates(spark):
        inner = materialize(spark.range(3), "a")
        with intermediates(spark):
            deep = place(materialize(spark.range(3), "b"))
        assert not os.path.exists(deep) and os.path.exists(place(inner))
        gone = place(inner)
        inner.write.parquet(out)
    assert not os.path.exists(gone) and spark.read.parquet(out).count() == 3
    kept = materialize(spark.range(2), "c")
    with pytest.raises(ZeroDivisionError), intermediates(spark):
        gone = place(materialize(spark.range(3), "d"))
        1 / 0
    assert not os.path.exists(gone) and kept.count() == 2
