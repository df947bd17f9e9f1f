"""Token counts, periodic runs and hard negatives against the library and brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, periods, quality_lm, token_counts
from lodestone.operators import retrieval

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string"


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


# 12

def odd_texts(n, seed):
    """Texts of characters that meet at every kind of boundary."""
    r = random.Random(seed)
    alphabet = [*"aZ09 \t\n\r.,!'", "'s", "'re", "<|endoftext|>", "<|endof", "text|>", "é", "ß", "日", "本", "。", "、", "カ", "한", " ", " ", " ", "\x1c", "\x85", "​", "́", "\U0001F600", "٠", "_", "  ", "\n\n"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_library(spark):
    texts = [*odd_texts(3000, 1), "<|endoftext|>", " <|endoftext|>  <|endoftext|>\n", "x" * 70_000, "日本、" * 20_000 + "。 end", " " * 50_000 + "x", ("word, " * 40_000).strip(), "!\x1c!", "\x1c \x1c"]
    rows = [(i, x, "en") for i, x in enumerate(texts)] + [(None, None, None), (7, "twice", "en"), (7, "twice", "en"), (8, None, "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_bytes", F.lit("mine")).withColumn("n_tokens", F.lit("mine"))
    t = library()
    want = sorted(((i, lang, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, lang in rows), key=repr)
    got = token_counts.count(df, VOCABULARY, keep=["doc_id", "lang"])
    assert got.columns == ["doc_id", "lang", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_token_counts_keep_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "en")], DOCS)
    assert token_counts.count(df, VOCABULARY).collect() == [(1, "a b", "en", 3, 2)]
    assert token_counts.count(df.where("false"), VOCABULARY).count() == 0


@pytest.mark.parametrize("batch, long", [(1, 1), (8, 4)])
def test_token_counts_do_not_depend_on_their_bounds(monkeypatch, batch, long):
    for name, value in (("BATCH_BYTES", batch), ("LONG_PIECE", long)):
        monkeypatch.setattr(token_counts, name, value)
    with open(VOCABULARY, encoding="utf-8") as f:
        source = f.read()
    t = library()
    for text in [*odd_texts(400, 2), "日本、日本。日本、" * 9]:
        cut = token_counts.pieces(text)
        assert "".join(cut) == text
        assert sum(token_counts.lengths(cut, source)) == len(t.encode(text, add_special_tokens=False).ids)


# 13

def brute_negatives(rows, every=100, scale=256.0, n_pos=5, n_neg=10, low=30, high=90):
    """rows(id, vector, label, ..) -> the rows of hard_negatives.mine, pair by pair."""
    fit = [(i, [math.floor(scale * x) for x in v], y) for i, v, y, *_ in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in fit if i % every == 0}:
        met = [(-dot(v, w), j, z) for j, w, z in fit if len(w) == len(v)]
        for s, j, _ in sorted(x for x in met if x[2] == y and x[1] != i)[:n_pos]:
            inside = sorted((t, k) for t, k, z in met if z != y and low * -s <= 100 * -t <= high * -s)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(inside[:n_neg])]
    return sorted(out)


def vectors(n, dim, seed, size=1.0):
    r = random.Random(seed)
    return [(i, [r.choice((0.0, -size, size, r.uniform(-size, size))) for _ in range(dim)], r.randint(0, 3)) for i in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int, _own string"


@pytest.mark.parametrize("dim, size, chunk, block", [(4, 1.0, 7, 4096), (4, 1.0, 1024, 8), (1, 0.01, 64, 16), (8, 2.0**14, 64, 4096), (2, 2.0**17, 5, 4096)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim, size, chunk, block):
    """Few distinct vectors, so that scores tie at every edge; components that take three, two or one field."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = [(*x, "mine") for x in vectors(300, dim, dim, size)]
    rows += [(600 + k, rows[0][1], k % 3, "same") for k in range(80)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, n_positives=3, n_negatives=4)
    held = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as 32-bit floats
    assert sorted(map(tuple, got.collect())) == brute_negatives(held, 10, n_pos=3, n_neg=4) != []


def test_hard_negatives_meet_nulls_repeats_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1, "x"), (0, [1.0, 1.0], 1, "x"), (0, [0.5, 1.0], 2, "other"), (1, [1.0, 0.9], 1, None), (1, [1.0, 0.9], 1, None), (2, [0.5, 0.5], 2, None), (2, [0.5, 0.5], 2, None), (3, [0.5, 0.4], 3, None), (None, [0.5, 0.5], 2, None), (4, None, 2, None), (5, [0.5, 0.5], None, None),
            (6, [0.5, None], 2, None), (7, [nan, 0.5], 2, None), (8, [inf, 0.5], 2, None), (9, [-inf, 0.5], 2, None), (11, [0.5], 2, None), (100, [1.0], 1, None), (12, [2.0], 1, None), (13, [], 1, None), (200, [], 1, None), (14, [], 2, None), (-100, [0.0, 0.0], 3, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows) != []
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_packed_products_are_exact():
    r = np.random.default_rng(3)
    for bits in (0, 3, 8, 14, 20, 22):
        a, c = (r.integers(-(2**bits), 2**bits, (9, 12), endpoint=True).astype(float) for _ in range(2))
        assert (hard_negatives.scores(a, c[:7]) == a.astype(np.int64) @ c[:7].astype(np.int64).T).all()
    assert hard_negatives.scores(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2
    with pytest.raises(ValueError, match="bits"):
        hard_negatives.scores(np.full((1, 1), 2.0**40), np.full((1, 1), 2.0**40))


# 11

def brute_runs(w, least=12):
    """Every maximal stretch of each period, in order of periods: a stretch counts for its smallest."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        x = 0
        while x + p < len(w):
            start = x
            while x + p < len(w) and w[x] == w[x + p]:
                x += 1
            if x - start >= p and x - start + p >= least:
                out.setdefault((start, x - start + p), p)
            x += x == start
    return sorted((s, n, p) for (s, n), p in out.items())


def periodic(r, few):
    """Words of a small alphabet with repeated passages of several periods put in."""
    out = [r.randint(1, few) for _ in range(r.randint(0, 120))]
    for _ in range(r.randint(0, 3)):
        passage, at = [r.randint(1, 50) for _ in range(r.randint(1, 60))], r.randint(0, len(out))
        out[at:at] = (passage * r.randint(2, 9))[: r.randint(1, 300)]
    return out


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(60):
        some = [periodic(r, r.randint(1, 4)) for _ in range(r.randint(1, 8))]
        for w, runs in zip(some, periods.runs_of([np.array(w, np.int64) for w in some], least)):
            assert list(map(tuple, runs.tolist())) == brute_runs(w, least)


def test_cover_reaches_every_pair():
    assert {(a - b) % periods.PERIOD for a in periods.COVER for b in periods.COVER} == set(range(periods.PERIOD))


def test_extensions_equal_brute_force():
    r = random.Random(5)
    texts = periods.Texts([np.array(periodic(r, 2), np.int64) for _ in range(6)])
    extend, w = periods.Extensions(texts), texts.words
    for k, n in enumerate(texts.sizes):
        a, b = (texts.starts[k] + np.array([r.randint(0, n) for _ in range(300)]) for _ in range(2))
        a, b = a[a != b], b[a != b]
        want = [next(t for t in range(1 << 20) if w[x + t] != w[y + t] or not w[x + t]) for x, y in zip(a, b)]
        assert extend(a, b).tolist() == want


def run_digests(i, text):
    """A row of the query, word by word, for a text that is as it is."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(runs), s, n, q, runs and 1000 * n // q or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_run_digests_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "\n", "\t \x0b"]).join(f"w{x}é" for x in periodic(r, 3)), "en") for i in range(40)]
    rows += [(None, None, None), (50, "", None), (51, " \n ", "en"), (52, "a " * 30, "en"), (52, "a " * 30, "en"), (None, "x y " * 9, None), (53, " ".join(map(str, range(40_000))), "en"), (54, "one two\x85three " * 40, "en"), (55, "\x1c \x1c " * 12, "en")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit("mine"), "collapsed": F.lit("mine")})
    want = sorted((run_digests(i, x) for i, x, _ in rows if i != 53), key=repr)
    for block, pairs in ((1 << 17, 1 << 20), (100, 50)):
        monkeypatch.setattr(periods, "BLOCK_WORDS", block)
        monkeypatch.setattr(periods, "PAIRS", pairs)
        small = df if block > 100 else df.where("doc_id IS NULL OR doc_id <> 53")
        got = [tuple(x) for x in periods.digests(periods.find(small)).collect()]
        assert sorted((x for x in got if x[0] != 53), key=repr) == want
    assert periods.find(df.where("false")).columns == ["doc_id", "text", "lang", "runs", "collapsed"]
    assert periods.digests(periods.find(df.where("false"))).count() == 0


def test_texts_made_periodic(spark):
    ids = [None, *range(200)]
    text = "a b\tc  d e f g h i j k l m n o p q r s t u v"
    rows = [(i, text, "en") for i in ids] + [(i, x, None) for i in range(60) for x in (None, "", " ", "one")]
    got = periods.made_periodic(spark.createDataFrame(rows, DOCS))
    want = []
    for i, x, lang in rows:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", x or ""), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            x = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))
        want.append((i, x, lang))
    assert sum(x != y for x, y in zip(want, rows)) > 5
    assert sorted(((i, x or "", y) for i, x, y in map(tuple, got.collect())), key=repr) == sorted(((i, x or "", y) for i, x, y in want), key=repr)


@pytest.mark.parametrize("few", [1_000_000, 10])
def test_all_trusted_documents_count(spark, few):
    """More than a million labels: those of documents that are there count as if there were no others."""
    r = random.Random(5)
    rows = [(i, " ".join("".join(r.choice("aeio") + r.choice("lnrst") for _ in range(3)) for _ in range(8)), "en", "s", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.range(1_200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    read = lambda out: {x.doc_id: (x.log_perplexity, x.threshold) for x in out.collect()}
    own = read(quality_lm.classify(df, labels.where("doc_id < 300")))
    assert read(quality_lm.classify(df, labels, **({"few_ids": few} if few < 1_000_000 else {}))) == own


def test_quantiles_by_counts_are_exact(spark):
    r = random.Random(6)
    rows = [(f"l{i % 4}", round(r.gauss(5, 1) if i % 4 else r.choice([1.0, 2.0, 2.000001]), 6)) for i in range(3000)] + [("one", 1.5), ("two", -1.0), ("two", 3.0)]
    df = spark.createDataFrame(rows, "_lang string, s double")
    for q in (0.0, 0.37, 0.999, 1.0):
        got = {x._lang: x._quantile for x in quality_lm.quantiles(df, q, "_lang").collect()}
        want = {x._lang: x.p for x in df.groupBy("_lang").agg(F.percentile("s", q).alias("p")).collect()}
        assert got == pytest.approx(want, abs=1e-12)
