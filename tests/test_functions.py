"""Column functions against plain Python on golden cases and random Unicode strings."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import rouge, triples as tr, text as tx, vectors as vx


def normalized(s):
    """Lower case, no ASCII punctuation, no article as a word of its own, single spaces."""
    bare = s.lower().translate({ord(c): None for c in string.punctuation})
    pieces = re.split(r"(\W+)", bare)
    return " ".join("".join(" " if p in ("a", "an", "the") else p for p in pieces).split())


def clean(doc):
    """At least three characters between the blanks, ASCII, not only dots, and at most 3 of 10 a symbol."""
    inner = doc.strip()
    kinds = ["word" if c.isalnum() else "blank" if c.isspace() else "symbol" for c in doc]
    return doc.isascii() and len(inner) > 2 and inner not in {"...", ". . ."} and 10 * kinds.count("symbol") <= 3 * len(kinds)


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    pool = list("aAnthe  \t\n\x0b\x1c\x85  .,!?'\"-_()[]{}<>|*~0129éßñ²½日中́“”") + [" the ", " a ", "An ", "...", "THE"]
    made = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(6000)] + ["", " ", ".", "ab ", " . . . ", "...", "the end", "“the end”", "abc"]
    return spark.createDataFrame(list(enumerate(made)), "i int, t string").repartition(4).cache()


def test_normalize_answer(texts):
    bad = [(r.t, r.n) for r in texts.select("t", tx.normalize_answer(F.col("t")).alias("n")).collect() if r.n != normalized(r.t)]
    assert not bad, bad[:5]


def test_is_clean(texts):
    bad = [r.t for r in texts.select("t", tx.is_clean(F.col("t")).alias("n")).collect() if r.n != clean(r.t)]
    assert not bad, bad[:5]
    assert texts.limit(1).select(tx.is_clean(F.lit(None).cast("string")).alias("n")).first().n is False


def test_strip_and_words(texts):
    for r in texts.select("t", tx.strip(F.col("t")).alias("s"), tx.split_words(F.col("t")).alias("w")).collect():
        assert r.s == r.t.strip() and r.w == r.t.split()


def test_token_f1(spark):
    r = random.Random(2)
    pairs = [(" ".join(r.choice("x y z the a b".split()) for _ in range(r.randint(0, 8))), " ".join(r.choice("x y z the a b".split()) for _ in range(r.randint(0, 8)))) for _ in range(500)]
    for row in spark.createDataFrame(pairs, "p string, g string").select("p", "g", tx.token_f1(F.col("p"), F.col("g")).alias("f")).collect():
        p, g = normalized(row.p).split(), normalized(row.g).split()
        same = sum((Counter(p) & Counter(g)).values())
        assert row.f == pytest.approx(0 if not same else 2 * same / (len(p) + len(g)))


@pytest.mark.parametrize("function,value,want", [
    (tx.remove_citations, "a [1] b [23 | c]", "a b c"),
    (tx.fix_spacing, "end.Next!Go 3.5 é.è", "end. Next! Go 3. 5 é. è"), (tx.strip_control_tokens, " [Relevant]ok[Utility:5]</s>", "ok"), (tx.strip_control_tokens, "", ""),
    (tx.clean_answer, "x [a] <paragraph>p</paragraph>  y\n<paragraph>p\nq</paragraph>", "x y <paragraph>p q</paragraph>"), (tx.question_key, "Do. Question:  why? Question: b", "why?"), (tx.question_key, "none", None),
    (tx.anchors_to_text, 'a <a href="x">b</a> <a href="y"></a>', 'a b <a href="y"></a>'), (tx.paragraphs, "<paragraph> a\nb </paragraph><paragraph>c</paragraph>", ["a\nb", "c"]), (tx.first_tokens, "a  b c!?", "a b c")])
def test_text_golden(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y == want


def test_triples_golden(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    text = "(S> Mara| P> Lives in| O> Oslo), (S> Mara| P> Plays| O> cello)"
    assert one(tr.split, text) == ["(S> Mara| P> Lives in| O> Oslo)", "(S> Mara| P> Plays| O> cello)"]
    assert one(lambda x: tr.join(tr.split(x)), text) == text
    assert tuple(one(tr.parse, "(S> John| P> Employer| O> Google (US))")) == ("John", "Employer", "Google (US")
    assert one(tr.parse, "(S> John| P> works)") is None and one(tr.extract, "(a), (b (c))") == ["a", "b (c"]
    assert [one(tr.is_valid, t) for t in ("(S> a| P> b| O> c)", "(S> a| P> b| P> c)", "(S> a| P> b| O> c| O> d)", "")] == [True, False, False, False]
    assert one(tr.expand_objects, "(S> a| P> b| O> c| O> d)") == ["(S> a| P> b| O> c)", "(S> a| P> b| O> d)"]


def test_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, *[list(map(float, r.normal(size=8))) for _ in range(2)]) for i in range(50)] + [(50, [0.0] * 8, [0.0] * 8)]
    a, b = F.col("a"), F.col("b")
    p, q = vx.distribution(F.transform(a, F.abs)), vx.distribution(F.transform(b, F.abs))
    out = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", "a", "b", vx.dot(a, b).alias("dot"), vx.squared_l2(a, b).alias("l2"), vx.cosine(a, b).alias("cos"), vx.normalized(a).alias("unit"), vx.softmax(a).alias("soft"), vx.jensen_shannon(p, q).alias("js"), vx.wasserstein_values(p, q).alias("w"), vx.top_positions(a, 3).alias("top"))
    for x in out.collect():
        u, v = np.array(x.a), np.array(x.b)
        assert x.dot == pytest.approx(u @ v) and x.l2 == pytest.approx(((u - v) ** 2).sum())
        n = np.linalg.norm(u)
        assert np.allclose(x.unit, u / (n or 1)) and np.allclose(x.soft, np.exp(u - u.max()) / np.exp(u - u.max()).sum())
        assert (x.cos is None) if not n else x.cos == pytest.approx(u @ v / n / np.linalg.norm(v))
        P, Q = (np.clip(np.abs(y), 1e-15, 1) / np.clip(np.abs(y), 1e-15, 1).sum() for y in (u, v))
        M = (P + Q) / 2
        assert x.js == pytest.approx(math.sqrt(max(0, (P * np.log(P / M)).sum() / 2 + (Q * np.log(Q / M)).sum() / 2)), abs=1e-7)
        assert x.w == pytest.approx(np.abs(np.sort(P) - np.sort(Q)).mean())
        assert [y.i for y in x.top] == sorted(range(8), key=lambda k: (-u[k], k))[:3]


def test_rouge():
    assert rouge.lsum("the cat sat", "the cat sat") == 1 and rouge.lsum("", "x") == 0 and rouge.lsum("a b. c d.", "c d. a b.") == 1
    assert rouge.lsum("w1 w2 w6 w7 w8", "w1 w2 w3 w4 w5") == pytest.approx(0.4)


def test_closed_answer_and_entities(spark):
    rows = [("A or C", "arc_c", "A B C D", "C"), ("SUPPORTS", "fever", None, "true"), ("REFUTES", "fever", None, "REFUTES"), ("TRUE", "fever", "x", "true"), ("none", "arc_c", "A B", "none")]
    for r in spark.createDataFrame(rows, "o string, t string, c string, w string").select("w", tx.closed_answer(F.col("o"), F.col("t"), F.col("c")).alias("y")).collect():
        assert r.y == r.w
    got = spark.createDataFrame([("Ann Lee <person> in Rome <city>",)], "x string").select(tx.entity_tags(F.col("x")).alias("e")).first().e
    assert {e.k: e.v for e in reversed(got)}["Ann Lee"] == "person" and len(got) == 2


def test_soft_match(spark):
    rows = [("The Red fox.", ["fox"], [1.0, 0.0], [[0.0, 1.0]]), ("dog", ["cat", "bird"], [1.0, 0.0], [[0.0, 1.0], [1.0, 0.2]]), ("dog", ["cat"], [1.0, 0.0], [[0.5, 1.0]]), ("dog", ["cat"], [0.0, 0.0], [[0.5, 1.0]]), (None, ["cat"], None, None)]
    df = spark.createDataFrame(rows, "p string, g array<string>, v array<double>, gv array<array<double>>")
    got = [tuple(r) for r in df.select(*tx.soft_match(F.col("p"), F.col("g"), F.col("v"), F.col("gv"))).collect()]
    assert got == [(True, False), (True, True), (False, False), (False, False), (False, False)]


def test_f1_counts_repeats(spark):
    from collections import Counter

    r = random.Random(9)
    rows = [(" ".join(r.choices(["red", "fox", "The", "b.", "c c"], k=r.randrange(0, 40))), [" ".join(r.choices(["red", "fox", "b", "d"], k=r.randrange(0, 40))) for _ in range(3)]) for _ in range(60)]

    def f1(p, g):
        p, g = normalized(p).split(), normalized(g).split()
        same = sum((Counter(p) & Counter(g)).values())
        return 2 * same / (len(p) + len(g)) if same else 0.0

    got = spark.createDataFrame(rows, "p string, g array<string>").select("p", "g", tx.best_f1(F.col("p"), F.col("g")).alias("f"), tx.token_f1(F.col("p"), F.col("g")[0]).alias("one")).collect()
    assert all(abs(x.f - max(f1(x.p, g) for g in x.g)) < 1e-12 and abs(x.one - f1(x.p, x.g[0])) < 1e-12 for x in got)


def test_graphs(spark):
    rows = [(1, "(S> b| P> knows| O> a)"), (1, "(S> a| P> has| O> c)"), (2, "(S> a| P> broken)"), (2, "(S> a| P> p| O> b)"), (3, "(S> a| P> p| O> a)")]
    graph = tr.graphs(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert {r.k: r.names for r in graph.collect()} == {1: ["a", "b", "c"], 3: ["a"]}
    got = {tuple(r) for r in tr.edges(graph, "k").collect()}
    assert got == {(1, 1, 0, "knows"), (1, 0, 1, "inverse_knows"), (1, 0, 2, "has"), (1, 2, 0, "inverse_has"), (3, 0, 0, "p"), (3, 0, 0, "inverse_p")}


def test_neighbor_means_equal_those_of_the_edges(spark):
    """Loops, repeated facts, a graph that fails; nothing is grouped but the triples, in tasks whose number grows with them."""
    r = random.Random(11)
    rows = [(k, f"(S> {r.choice('abcde')}| P> p| O> {r.choice('abcde')})") for k in range(30) for _ in range(r.randrange(1, 9))] + [(31, "(S> a| P> b)"), (31, "(S> a| P> p| O> b)"), (None, "(S> a| P> p| O> a)")]
    graph = tr.graphs(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    met = {}
    for e in tr.edges(graph, "k").collect():
        met.setdefault((e.k, e.dst), []).append(e.src)
    means = tr.neighbor_means(graph, "k")
    plan = means._jdf.queryExecution().executedPlan().toString().replace("ObjectHashAggregate", "")
    assert {(x.k, x.node_idx): (x["mean"], x.n) for x in means.collect()} == {at: (sum(v) / len(v), len(v)) for at, v in met.items()}
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert [tr.tasks(n) for n in (0, 600_000, 36_000_000, 216_000_000, 4_000_000_000)] == [1, 10, 200, 200, 1908]
