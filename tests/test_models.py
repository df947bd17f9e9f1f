"""Networks, message passing and triple extraction against plain NumPy and Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import extraction
from lodestone.operators import graphs, networks, skew


def layer(r, n_out, n_in, activation="none"):
    return networks.Layer(r.normal(size=(n_out, n_in)), r.normal(size=n_out), activation)


def plain(layers, x):
    for one in layers:
        x = one.weight @ x + one.bias
        x = {"none": lambda v: v, "relu": lambda v: np.where(v > 0, v, 0), "sigmoid": lambda v: 1 / (1 + np.exp(-v)), "softmax": lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()}[one.activation](x)
    return x


def test_forward_equals_plain_products(spark):
    r = np.random.default_rng(1)
    layers = [layer(r, 7, 4, "relu"), layer(r, 5, 7, "sigmoid"), layer(r, 3, 5, "softmax")]
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    held = {x.id: x.v for x in df.collect()}
    got = {x.id: x.y for x in df.select("id", networks.forward(F.col("v"), layers).alias("y")).collect()}
    assert got.pop(99) is None and len(got) == 50
    for i, y in got.items():
        assert y == pytest.approx(plain(layers, np.array(held[i])).tolist())
    assert df.where("id = 99").select(networks.forward(F.col("v"), layers).alias("y")).first().y is None
    assert df.where("false").select(networks.forward(F.col("v"), layers)).count() == 0


def test_networks_check_their_weights_and_vectors(spark, monkeypatch):
    r = np.random.default_rng(2)
    with pytest.raises(ValueError, match="layer 1"):
        networks.checked([layer(r, 3, 4), layer(r, 2, 5)])
    for bad in ([1.0], [1.0, None], []):
        with pytest.raises(Exception, match="vectors of 2 numbers"):
            spark.createDataFrame([([1.0, 2.0],), (bad,)], "v array<double>").select(networks.forward(F.col("v"), [layer(r, 3, 2)])).collect()
    monkeypatch.setattr(networks, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError, match="weights"):
        networks.checked([layer(r, 3, 4)])


def test_themes_of_questions_and_documents(spark):
    r = np.random.default_rng(3)
    classifier, shifter = [layer(r, 6, 4, "sigmoid")], [layer(r, 6, 6, "softmax")]
    df = spark.createDataFrame([(1, "q", [0.1, 0.2, 0.3, 0.4]), (2, "d", [0.1, 0.2, 0.3, 0.4]), (3, None, [1.0, -1.0, 1.0, -1.0]), (4, "q", None)], "id int, mode string, v array<double>")
    got = {x.id: x for x in networks.themes(df, "v", classifier, shifter, F.col("mode"), list("abcdef"), 2).collect()}
    p = plain(classifier, np.array([0.1, 0.2, 0.3, 0.4]))
    assert got[2].theme == pytest.approx(p.tolist(), abs=1e-8) and got[1].theme == pytest.approx(plain(shifter, p).tolist(), abs=1e-8)
    assert got[1].labels == got[2].labels == [n for n, x in zip("abcdef", p) if x > 0.5]
    assert [x.name for x in got[2].top] == ["abcdef"[i] for i in np.argsort(-p)[:2]] and got[3].theme is not None and got[4].theme is None


def plain_rounds(h, edges, rounds, how, layers=None):
    h = {k: np.array(v, float) for k, v in h.items()}
    degree = {k: 1 + sum(d == k for _, d in edges) for k in h}
    cosine = lambda a, b: a @ b / n if (n := math.sqrt(a @ a) * math.sqrt(b @ b)) else 0.0
    for t in range(rounds):
        h = {k: plain(layers[t : t + 1], v) for k, v in h.items()} if layers else h
        new = {}
        for k in h:
            met = [h[s] for s, d in edges if d == k]
            if how == "gcn":
                new[k] = sum((h[s] / math.sqrt(degree[s] * degree[k]) for s, d in edges if d == k), h[k] / degree[k])
            else:
                w = [math.exp(cosine(h[k], x) / 0.5) for x in [h[k], *met]]
                new[k] = sum(a * x for a, x in zip(w, [h[k], *met])) / sum(w)
        h = new
    return h


@pytest.mark.parametrize("how, layered, hot", [("gcn", False, 1000), ("gcn", True, 4), ("attention", False, 4), ("attention", True, 1000)])
def test_rounds_equal_plain_sums(spark, monkeypatch, how, layered, hot):
    """A hub with half of the edges, repeated edges, loops, a node without edges, ends that are no nodes."""
    monkeypatch.setattr(skew, "HOT", hot)
    r, n = random.Random(7), np.random.default_rng(7)
    h = {f"n{i}": [r.uniform(-1, 1) for _ in range(3)] for i in range(20)} | {"zero": [0.0, 0.0, 0.0], "alone": [1.0, 2.0, 3.0]}
    names = [k for k in h if k != "alone"]
    edges = [(r.choice(names), r.choice(names)) for _ in range(60)] + [("n0", r.choice(names)) for _ in range(40)] + [(r.choice(names), "n0") for _ in range(40)]
    layers = [layer(n, 4, 3, "relu"), layer(n, 2, 4)] if layered else None
    nodes = spark.createDataFrame(list(h.items()), "node string, h array<double>")
    table = spark.createDataFrame([*edges, (None, "n1"), ("n1", None), ("ghost", "n1"), ("n1", "ghost")], "src string, dst string")
    got = {x.node: x.h for x in graphs.propagate(nodes, table, 2, how, layers, 0.5).collect()}
    want = plain_rounds(h, edges, 2, how, layers)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v.tolist(), abs=1e-6)


def test_rounds_without_edges_or_nodes(spark):
    nodes = spark.createDataFrame([("a", [4.0])], "node string, h array<double>")
    none = spark.createDataFrame([], "src string, dst string")
    assert graphs.propagate(nodes, none, 3).collect() == [("a", [4.0])]
    assert graphs.propagate(nodes.where("false"), none, 2, "attention").count() == 0


def test_edges_travel_as_short_lists_and_are_added_by_batch(monkeypatch):
    """A hub on either side, repeated edges, batches smaller than a node's edges, and tasks that get nothing."""
    monkeypatch.setattr(graphs, "BATCH", 50)
    monkeypatch.setattr(graphs, "LIST", 4)
    r = np.random.default_rng(5)
    src, dst = np.where(r.random(400) < 0.4, 7, r.integers(0, 30, 400)), np.where(r.random(400) < 0.4, 2**40, r.integers(0, 30, 400))
    batch = lambda names, *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
    lists = list(graphs._pack(batch(["src", "dst"], src[k : k + 30], dst[k : k + 30]) for k in range(0, 400, 30)))
    rows = [x for b in lists for x in b.to_pylist()]
    assert sorted((x["src"], y) for x in rows for y in x["to"]) == sorted(zip(src.tolist(), dst.tolist()))
    assert max(len(x["to"]) for x in rows) == 4 and len(rows) < 400
    sent = list(graphs._sender(2, 3)(batch(["to", "_0", "_1"], b["to"], b["src"].to_numpy() * 1.0, b["src"].to_numpy() * -0.5) for b in lists))
    assert sum(len(x["_id"]) for b in sent for x in b.to_pylist()) < 400
    assert all(i % 3 == x["_block"] for b in sent for x in b.to_pylist() for i in x["_id"])
    got = {x["_id"]: x["_sum"] for b in graphs._adder(2)(iter(sent)) for x in b.to_pylist()}
    assert got == {d: [float(src[dst == d].sum()), -0.5 * src[dst == d].sum()] for d in set(dst.tolist())}
    assert not [*graphs._pack(iter([])), *graphs._sender(2, 3)(iter([])), *graphs._adder(2)(iter([]))]


@pytest.mark.parametrize("how", ["gcn", "attention"])
def test_edges_that_count_both_ways(spark, how):
    nodes = spark.createDataFrame([("a", [4.0, 1.0]), ("b", [1.0, 2.0]), ("c", [0.5, 3.0]), (None, [1.0, 1.0])], "node string, h array<double>")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("a", "ghost"), (None, "a")], "src string, dst string")
    inverse = edges.selectExpr("dst AS src", "src AS dst")
    got, want = graphs.propagate(nodes, edges, 2, how, both=True), graphs.propagate(nodes, edges.unionByName(inverse), 2, how)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 4


def test_replies_as_rows(spark):
    replies = {"whole": "(S> a b| P> is| O> c), (S> d| P> of| O> e| O> f)", "bad": "(S> a| P> b), (S> x| P> y| O> ), (nothing), (P> a| S> b| O> c), (S> a| P> b| O> c)", "empty": "", "none": None}

    def hook(text):
        return replies[text]  # KeyError for others

    extraction.register(spark, hook, "replies")
    df = spark.createDataFrame([(1, "whole"), (2, "bad"), (3, "empty"), (4, "none"), (5, "fails"), (6, None)], "id int, text string")
    got = spark.sql("SELECT id, t.* FROM {df} AS d, LATERAL replies(d.text) AS t", df=df).collect()
    assert sorted((r.id, r.s, r.p, r.o) for r in got if r.ok) == [(1, "a b", "is", "c"), (1, "d", "of", "e"), (1, "d", "of", "f"), (2, "a", "b", "c")]
    assert sorted((r.id, r.raw) for r in got if not r.ok) == [(2, "(P> a| S> b| O> c"), (2, "(S> a| P> b"), (2, "(S> x| P> y| O>"), (2, "(nothing"), (5, "(failed)")]
