"""Two-stage retrieval against brute force: ties, nulls, splits, and what its passes emit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval

VECS = "vec_id long, split_id int, v array<double>, theme array<double>"
QUERIES = "query_id long, q array<double>, theme array<double>"


def rows(n, seed, few):
    r = random.Random(seed)
    return [(i, i % 3, [r.uniform(-1, 1) for _ in range(4)], [float(r.choice([0, 1, 2])) if few else r.uniform(0, 1) for _ in range(3)]) for i in range(n)]


def brute(vecs, queries, theme_k, dense_k, k, w, metric, split):
    """Every query against every row, stage by stage."""
    out = []
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)) if metric == "ip" else -sum((x - y) ** 2 for x, y in zip(a, b)), 6)
    for qid, q, theme in queries:
        if q is None:
            continue
        for g in sorted({s for _, s, _, _ in vecs}) if split else [None]:
            own = [x for x in vecs if x[2] is not None and (g is None or x[1] == g)]
            dense = {i: round(sum(a * b for a, b in zip(v, q)), 6) for i, _, v, _ in own}
            if theme is None or not any(theme):
                best = sorted((-s, i) for i, s in dense.items())[:k]
            else:
                first = sorted((-score(t, theme), i) for i, _, _, t in own if t is not None)[:theme_k]
                second = sorted((-dense[i], i, -s) for s, i in first)[:dense_k]
                best = sorted((-round(w * -d + round(1 - w, 9) * t, 8), i) for d, i, t in second)[:k]
            out += [(qid, *([g] if split else []), i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("metric, split, few, block", [("ip", False, True, 4096), ("ip", True, False, 4), ("l2", True, True, 4096), ("l2", False, False, 4096)])
def test_two_stages_equal_brute_force(spark, monkeypatch, metric, split, few, block):
    """Few distinct themes make ties at the edge; themes and vectors that are null, here and there."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    vecs = [*rows(150, 1, few), (900, 0, None, [1.0, 1.0, 1.0]), (901, 1, [1.0] * 4, None)]
    queries = [(i, q, t) for i, _, q, t in rows(9, 2, few)] + [(20, [1.0, 0.0, 0.0, 0.0], None), (21, None, [1.0, 1.0, 1.0]), (22, [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0]), (23, None, None)]
    got = retrieval.theme_scoped(spark.createDataFrame(vecs, VECS).repartition(5), spark.createDataFrame(queries, QUERIES), 20, 7, 4, 0.8, metric, split_col="split_id" if split else None)
    found, want = sorted(map(tuple, got.collect())), brute(vecs, queries, 20, 7, 4, 0.8, metric, split)
    assert [x[:-2] + x[-1:] for x in found] == [x[:-2] + x[-1:] for x in want]
    assert [x[-2] for x in found] == pytest.approx([x[-2] for x in want])
    assert {x[0] for x in found} == {x[0] for x in queries if x[1] is not None}


def test_little_more_than_the_best_is_emitted_and_nothing_joined(spark):
    vecs = spark.createDataFrame(rows(3000, 3, False), VECS).repartition(8)
    queries = spark.createDataFrame([(i, q, t) for i, _, q, t in rows(10, 4, False)], QUERIES)
    emitted = retrieval.scoped_candidates(vecs, queries, 100)
    assert 10 * 100 <= emitted.count() < 10 * 100 * 2
    plan = retrieval.theme_scoped(vecs, queries, 100, 10, 5, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_bins_keep_the_order_of_scores():
    s = np.sort(np.concatenate([np.random.default_rng(1).normal(size=5000) * 10.0 ** np.random.default_rng(2).integers(-6, 6, 5000), [0.0, -0.0]]))
    assert (np.diff(retrieval._bins(s)) >= 0).all()
    counts = retrieval.Counts(2)
    for part in np.split(np.stack([s[:5000], s[:5000][::-1]]), 10, 1):
        counts.meet(retrieval._bins(part))
    assert counts.table.sum(1).tolist() == [5000, 5000] and (counts.table[0] == counts.table[1]).all()


def test_themes_of_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_LABELS", 2)
    df = spark.createDataFrame([(i, [1.0], i) for i in range(3)], "vec_id long, v array<double>, label int")
    with pytest.raises(ValueError, match="labels"):
        retrieval.with_theme(df)
    assert retrieval.topk(df, df.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") > 0, F.col("v")).alias("q")), 1).count() == 2


def test_counts_take_few_places_and_zero_has_one_sign():
    """Scores of both signs need a bin for each thirtieth from a millionth on, not for all that floats can hold."""
    counts = retrieval.Counts(1)
    counts.meet(retrieval._bins(np.array([[-16.0, -1e-6, -0.0, 0.0, 1e-6, 16.0]])))
    assert counts.table.sum() == 6 and counts.table.shape[1] < 2000
    assert len(set(retrieval._bins(np.array([-0.0, 0.0])).tolist())) == 1
    assert not np.signbit(retrieval._scores(np.array([[1e-8]]), np.array([[-1.0]]), "ip", 6)).any()


@pytest.mark.parametrize("themes, split", [("many", False), ("few", True), ("one", False), ("signs", False)])
def test_many_by_theme_are_chosen_by_vector_in_tasks(spark, monkeypatch, themes, split):
    """Ends by score and, where themes tie, by id; a task emits as many as the second stage takes, not what the first lets in."""
    emitted, made = [], retrieval.scoped_candidates
    monkeypatch.setattr(retrieval, "FEW", 40)
    monkeypatch.setattr(retrieval, "scoped_candidates", lambda *a, **k: emitted.append(made(*a, **k)) or emitted[-1])
    r = random.Random(5)
    theme = {"many": lambda: [r.uniform(0, 1) for _ in range(3)], "few": lambda: [float(r.choice([0, 1])) for _ in range(3)], "one": lambda: [1.0, 2.0, 3.0], "signs": lambda: [r.uniform(-1, 1), r.choice([0.0, -1.0]), 0.0]}[themes]
    vecs = [(r.choice([-1, 1]) * i * 2**40, i % 2, [r.uniform(-1, 1) for _ in range(4)], theme()) for i in range(1200)]
    queries = [(i, [r.uniform(-1, 1) for _ in range(4)], [1.0, r.uniform(0, 1), 0.5]) for i in range(6)]
    got = retrieval.theme_scoped(spark.createDataFrame(vecs, VECS).repartition(4), spark.createDataFrame(queries, QUERIES), 400, 5, 3, 0.9, split_col="split_id" if split else None)
    found, want = sorted(map(tuple, got.collect())), brute(vecs, queries, 400, 5, 3, 0.9, "ip", split)
    assert [x[:-2] + x[-1:] for x in found] == [x[:-2] + x[-1:] for x in want]
    assert [x[-2] for x in found] == pytest.approx([x[-2] for x in want])
    assert emitted[0].count() <= 6 * (2 if split else 1) * (4 * 5 + 40)


def test_bins_span_their_scores():
    s = np.concatenate([np.random.default_rng(3).normal(size=2000) * 10.0 ** np.random.default_rng(4).integers(-6, 6, 2000), [0.0, 1e-6, -1e-6, np.finfo(np.float64).max, -np.finfo(np.float64).max]])
    least, most = retrieval._span(retrieval._bins(s))
    assert ((least <= s) & (s <= most)).all()
    assert (retrieval._bins(least) == retrieval._bins(s)).all() and (retrieval._bins(most) == retrieval._bins(s)).all()


@pytest.mark.parametrize("metric, split", [("ip", False), ("l2", True)])
def test_without_stages_all_rows_are_blended(spark, metric, split):
    vecs = [*rows(150, 6, True), (900, 0, None, [1.0, 1.0, 1.0]), (901, 1, [1.0] * 4, None)]
    queries = [(i, q, t) for i, _, q, t in rows(9, 7, True)] + [(20, [1.0, 0.0, 0.0, 0.0], None), (21, None, [1.0, 1.0, 1.0])]
    got = retrieval.theme_scoped(spark.createDataFrame(vecs, VECS).repartition(5), spark.createDataFrame(queries, QUERIES), None, None, 4, 0.8, metric, split_col="split_id" if split else None)
    found, want = sorted(map(tuple, got.collect())), brute(vecs, queries, 999, 999, 4, 0.8, metric, split)
    assert [x[:-2] + x[-1:] for x in found] == [x[:-2] + x[-1:] for x in want]
    assert [x[-2] for x in found] == pytest.approx([x[-2] for x in want])


def test_flagship_query_considers_every_row(spark, tmp_path):
    """Rows beyond the 100 best by theme, and the 50 best of these by vector, can be among the ten best by both."""
    from lodestone import plans

    r = random.Random(8)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)], i % 10) for i in range(400)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    themed = retrieval.with_theme(spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")).collect()
    vecs = [(x.vec_id, 0, x.v, x.theme) for x in themed]
    want = brute(vecs, [(i, v, t) for i, _, v, t in vecs if i % 50 == 0], 400, 400, 10, 0.8, "ip", False)
    got = plans.QUERIES["theme_scoped_topk"](spark, str(tmp_path)).select("query_id", "vec_id", "score", "rank").collect()
    assert sorted((x.query_id, x.vec_id, x["rank"]) for x in got) == sorted((q, i, n) for q, i, _, n in want)
