"""Stemming, ROUGE, metrics over gold answers and their spread."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import rouge, stemming
from lodestone.operators import evaluation

STEMS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll oscillators oscil generalizations gener died die spied spi dies die skies sky enjoy enjoy by by a a"""


def test_stems():
    words = STEMS.split()
    assert [stemming.stem(w) for w in words[::2]] == words[1::2]


def table_lcs(a, b):
    """Positions of a longest common subsequence by the whole table of lengths."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_common_subsequences_equal_the_table():
    r = random.Random(2)
    for _ in range(3000):
        k = r.randint(1, 6)
        a, b = ([r.randint(1, k) for _ in range(r.randint(0, 25))] for _ in range(2))
        assert rouge.common(a, b) == table_lcs(a, b)


def test_long_texts_take_little_memory():
    import tracemalloc

    r = random.Random(3)
    a, b = ([r.randint(1, 200) for _ in range(8000)] for _ in range(2))
    tracemalloc.start()
    found = rouge.common(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a[i] for i in found] and most < 8 << 20


def plain_scores(p, g):
    stems = lambda t: [stemming.stem(w) if len(w) > 3 else w for w in rouge._WORD.findall(t.lower())]
    sentences = lambda t: [s for x in t.replace("! ", "!\n").replace(". ", ".\n").split("\n") if (s := stems(x))]
    f = lambda hits, n, m: 2 * hits / (n + m) if hits else 0.0
    a, b = stems(p), stems(g)
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    out = {f"rouge{n}": f((grams(a, n) & grams(b, n)).total(), grams(a, n).total(), grams(b, n).total()) for n in (1, 2)}
    left, hits = Counter(a), 0
    for s in sentences(g):
        for w in [s[i] for i in sorted({i for x in sentences(p) for i in table_lcs(s, x)})]:
            hits += left[w] > 0
            left[w] -= left[w] > 0
    return out | {"rougeL": f(len(table_lcs(b, a)), len(a), len(b)), "rougeLsum": f(hits, len(a), len(b))}


def test_rouge_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["running", "runs", "Run", "the", "cat.", "cats", "sat!", "ponies", "pony", "x1", "été", "relational"]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 14)))
    rows = [(i, text(), [text() for _ in range(r.randint(0, 3))]) for i in range(60)] + [(98, None, ["a"]), (99, "a", None), (100, "a", [None, "a"])]
    df = spark.createDataFrame(rows, "id int, p string, golds array<string>")
    got = {x.id: x.r.asDict() for x in df.select("id", rouge.rouge(F.col("p"), F.col("golds")).alias("r")).collect()}
    for i, p, golds in rows:
        best = dict.fromkeys(rouge.KINDS, 0.0)
        for g in golds or []:
            new = plain_scores(p or "", g or "")
            best = new if new["rougeLsum"] >= best["rougeLsum"] else best
        assert got[i] == pytest.approx(best)
    assert df.where("false").select(rouge.rouge(F.col("p"), F.col("golds"))).count() == 0


def test_metrics_over_golds(spark):
    df = spark.createDataFrame([("The Cat!", ["dog", "a cat"], "x"), ("cats sat", ["sat", "cats"], "y"), ("z", [], "x"), (None, ["q"], "z")], "p string, golds array<string>, task string")
    got = [r.asDict() for r in evaluation.scored(df, "p", "golds", list(evaluation.METRICS)).collect()]
    assert [(r["em"], r["match"], r["contains"]) for r in got] == [(1, 1, 0), (0, 1, 1), (None, 0, None), (None, None, None)]
    own = evaluation.scored(df, "p", "golds", {"same_length": evaluation.over_golds(lambda p, g: (F.length(p) == F.length(g)).cast("double"))}).collect()
    assert [r.same_length for r in own] == [0, 0, None, None]
    assert [r.score for r in evaluation.by_task(df, "p", "golds", "task", {"x": "em", "y": lambda p, g: F.lit(7.0)}).collect()] == [1, 7, None, None]


def test_bootstrap_spread_is_that_of_the_mean(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(x), None if i % 2 else float(x), i % 4 == 0) for i, x in enumerate(r.normal(10, 3, 4000))]
    df = spark.createDataFrame(rows, "id long, m double, half double, g boolean")
    once = lambda d: sorted(map(tuple, evaluation.bootstrap(d, F.col("id"), ["m", "half"], [], 400).collect()))
    got = once(df)
    values = {"m": [x[1] for x in rows], "half": [x[2] for x in rows if x[2] is not None]}
    for metric, n, mean, low, mid, high in got:
        x, error = np.array(values[metric]), np.std(values[metric]) / math.sqrt(len(values[metric]))
        assert n == len(x) and mean == pytest.approx(x.mean()) and mid == pytest.approx(x.mean(), abs=0.4 * error)
        assert (high - low) / (2 * 1.96 * error) == pytest.approx(1, abs=0.15)
    again = once(df.repartition(7))
    assert [a[:2] for a in again] == [a[:2] for a in got] and np.allclose([a[2:] for a in again], [a[2:] for a in got])


def test_bootstrap_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 1.0, "a"), (1, None, "b"), (2, 3.0, None)], "id long, m double, g string")
    got = {r.g: r for r in evaluation.bootstrap(df, F.col("id"), ["m"], ["g"], 50).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].low, got["a"].high) == (2, 1, 1, 1) and (got["b"].n, got["b"].mean, got["b"].mid) == (0, None, None) and got[None].mean == 3
    assert evaluation.bootstrap(df.where("false"), F.col("id"), ["m"], ["g"], 50).count() == 0
