"""Numbered operators against brute force, round trips and their defined edge cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, exact_dedup, graph, licenses, line_rules, mixing, near_dedup, quality_lm, sharding, warc
from lodestone.tables import materialize

DOCS = "doc_id long, text string, lang string, source string, n string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


EDGE = [
    (1, "Hello  world\n\tagain", "en", "src1", "x"), (2, "Hello world again", "en", "src1", None), (3, None, None, None, None), (4, "", "en", "src2", "x"),
    (5, "   ", "de", "src2", "x"), (None, "no id", "en", "src1", "x"), (None, "no id", "en", "src1", "x"), (7, "twice", "en", "src3", "x"), (7, "twice", "en", "src3", "x"),
    (8, words(60_000, 8), "en", "src3", "x"), (9, "one\ntwo\ntwo\none two three four five six one two three four five", "fr", "src9", "x"), (10, "日本語 \U0001F600 é <|endoftext|> don't", "ja", "srcX", "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    """`df` with columns of names that operators use inside."""
    return df.withColumns({c: F.lit("mine") for c in names})


# 1

def test_bpe_equals_library(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    extra = ["a  <|endoftext|>!!<|endoftext|> b <|endoftext|>\n\n", "!" * 20000 + "<|endoftext|>" + " " * 20000 + "x", "'tis don't\r\n  x\0y\x1c z    aࡰࡱ \U00016130", "|endoftext|> <|endoftext"]
    df = edge.unionByName(spark.createDataFrame([(100 + i, x, None, None, None) for i, x in enumerate(extra)], DOCS))
    got = bpe.digests(bpe.decode(bpe.encode(clash(df, "ids", "decoded"), VOCABULARY), VOCABULARY)).collect()
    want = []
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), SHA(struct.pack(f"<{len(ids)}I", *ids)), SHA(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_keeps_columns_of_any_name(spark):
    df = clash(spark.createDataFrame([(1, "a b", "en", None, "x")], DOCS), "_words", "_words_").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = bpe.encode(df, VOCABULARY)
    assert out.columns == [*df.columns, "ids"] and [tuple(r)[:-1] for r in out.collect()] == [tuple(r) for r in df.collect()]


def test_bpe_empty_and_broken_ids(spark, none):
    assert bpe.digests(bpe.decode(bpe.encode(none, VOCABULARY), VOCABULARY)).count() == 0
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(VOCABULARY).encode("é\U0001F600").ids[:-1]  # ends inside a character
    df = spark.createDataFrame([(1, bytearray(struct.pack(f"<{len(ids)}I", *ids))), (2, None)], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(df, VOCABULARY).collect()} == {1: Tokenizer.from_file(VOCABULARY).decode(ids, skip_special_tokens=False), 2: ""}


# 2

def strict_turns(formatted):
    """Turns by the stated grammar, character by character."""
    at, out = 0, []

    def until(mark):
        nonlocal at
        value = ""
        while not formatted.startswith(mark, at):
            assert not formatted.startswith("### ", at) and not formatted.startswith("</turn>", at)
            at += formatted[at] == "\\"
            value += formatted[at]
            at += 1
        at += len(mark)
        return value

    while at < len(formatted):
        assert formatted.startswith("### ", at)
        at += 4
        out.append((until(": "), until("</turn>\n")))
    return out


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: </turn>\n\\"), (1, 2, "assistant", "b"), (2, 1, "a: b", None), (2, 0, None, "\\\\</turn>### x"), (3, 0, "assistant", ""),
            (None, None, "assistant", "z\\"), (4, 0, "user", "x\\n </turn"), (4, 0, "user", "x\\n </turn"), (5, 0, "assistant", "#### ### <</turn></turn>"), (6, 0, "user", "C:\\"), (6, 1, "assistant", "ok"), (7, 0, "a</turn>", "x"), (8, 0, "r\\", "x"), (9, 0, "user", "even\\\\")]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "turns", "plain", "formatted")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = sorted(turns)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), SHA("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), SHA(loss))
    assert {r.conv_id for r in out.where("NOT escaped").collect()} == {3}
    for r in out.collect():  # a strict parser of the grammar, and the characters under the mask
        assert strict_turns(r.formatted) == [(role, x) for _, role, x in sorted(convs[r.conv_id])]
        at, under = 0, []
        for run in r.loss_mask:
            if run.loss:
                under.append(re.sub(r"(?s)\\(.)", r"\1", r.formatted[at : at + run.chars]))
            at += run.chars
        assert at == len(r.formatted) and under == [x for _, role, x in sorted(convs[r.conv_id]) if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


# 3

PAGES = [(5, "http://a/x y\n", "same", "q"), (3, None, "same", "q"), (9, "u", "same", "q"), (1, "u", None, "q"), (2, "u", "", "q"), (4, "u", "é" * 300_000, "q"), (None, "u", "same", "q"), (None, "v", "alone", "q"), (None, "v", "alone", "q"),
         (7, "u", "b\r\n\r\nWARC/1.1", "q"), (7, "u", "b\r\n\r\nWARC/1.1", "q"), (7, "u", "other", "q"), (8, "u", "b\r\n\r\nWARC/1.1", "q")]


def test_warc_archives(spark, tmp_path):
    df = clash(spark.createDataFrame(PAGES, "page_id long, url string, html string, sha1 string"), "row", "_row", "payload", "copies")
    index = warc.write_archives(warc.plan_records(df), f"file:{tmp_path}/out", frame_bytes=1000, bundle_bytes=5000)
    records = warc.read_archives(spark, f"file:{tmp_path}/out", index).collect()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    first = {}
    for p, _, h, _ in PAGES:
        first[h or ""] = min([x for x in (first.get(h or ""), p) if x is not None], default=None)
    want = Counter()
    for p, _, h, _ in PAGES:
        b, f = (h or "").encode(), first[h or ""]
        again = f is not None and p != f
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None] += 1
    assert got == want
    # Every record has an id of its own; the index finds it by one frame; a revisit names its response.
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == len(PAGES) == index.count()
    for entry in index.collect():
        headers, payload = warc.fetch((tmp_path / "out" / f"{entry.bundle_id}.warc.zst").read_bytes(), entry)
        assert headers["WARC-Record-ID"] == entry.record_id and (by_id[entry.record_id].frame, by_id[entry.record_id].offset) == (entry.frame, entry.offset)
    for r in records:
        if r.record_type == "revisit":
            to = by_id[r.refers_to_record]
            assert (to.page_id, to.payload_digest, to.record_type) == (r.refers_to, r.payload_digest, "response")
    import zstandard

    for p in (tmp_path / "out").glob("*.zst"):  # any decoder reads the frames and skips the table
        assert zstandard.ZstdDecompressor().stream_reader(p.open("rb"), read_across_frames=True).read().startswith(b"WARC/1.1")
    # A file that no index row names is skipped.
    kept = index.where(F.col("bundle_id") != index.first()["bundle_id"])
    assert warc.read_archives(spark, f"file:{tmp_path}/out", kept).count() == kept.count() < len(PAGES)


def test_warc_bounds_and_files(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, sha1 string")
    assert warc.plan_records(df, min_bytes=5).where("refers_to IS NOT NULL").select("page_id").collect() == [(8,)]
    empty = warc.write_archives(warc.plan_records(df.limit(0)), f"{tmp_path}/none")
    assert empty.count() == 0 and warc.read_archives(spark, f"{tmp_path}/none", empty).count() == 0
    df.write.parquet(f"{tmp_path}/pages")  # places in files instead of a copy
    index = warc.write_archives(warc.plan_records(spark.read.parquet(f"{tmp_path}/pages")), f"{tmp_path}/files")
    assert len({r.record_id for r in warc.read_archives(spark, f"{tmp_path}/files", index).collect()}) == len(PAGES)


# 4

def test_exact_dedup(edge, none):
    got = Counter(map(tuple, exact_dedup.decide(clash(edge, "h", "norm", "copies")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    groups = defaultdict(list)
    for d, text, *_ in EDGE:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(d)
    want = Counter()
    for norm, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x))
        for k, d in enumerate(ids):
            want[d, ids[0], len(ids), k == 0, SHA(norm)] += 1
    assert got == want
    stay = exact_dedup.drop_copies(clash(edge, "h", "norm"))
    assert stay.count() == len(groups) and stay.columns[-1] == "norm"
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


# 5

class Kneser:
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""

    def __init__(self, texts):
        self.order, m = quality_lm.ORDER, quality_lm.ORDER
        grams = {k: Counter() for k in range(1, m + 1)}
        for t in texts:
            s = "\n" * (m - 1) + t
            grams[m].update(s[i - m + 1 : i + 1] for i in range(m - 1, len(s)))
        for k in range(m - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        self.grams, self.inside, self.d = grams, defaultdict(dict), {}
        for k in grams:
            for g, n in grams[k].items():
                self.inside[g[:-1]][g] = n
            n = [sum(v == j for v in grams[k].values()) for j in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
            self.d[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05 * j), j) if n[j - 1] and n[j] else 0.75 for j in (1, 2, 3)]

    def p(self, g):
        if not g:
            return quality_lm.UNIFORM
        inside = self.inside.get(g[:-1])
        if not inside:
            return self.p(g[1:])
        d = lambda v: self.d[len(g)][min(v, 3) - 1]
        total, c = sum(inside.values()), inside.get(g, 0)
        return (max(c - d(c), 0) if c else 0) / total + sum(map(d, inside.values())) / total * self.p(g[1:])

    def bits(self, t):
        s, m = "\n" * (self.order - 1) + t, self.order
        return -sum(math.log2(self.p(s[i - m + 1 : i + 1])) for i in range(m - 1, len(s)))


KN_TEXTS = ["abab abc. ", "cab bac ABC\n", "a", "", "bb aa bb aa", "\n\n a", "日本 日本 \U0001F600\U0001F600"]


@pytest.mark.parametrize("hot", [0, 20, 1 << 20])
def test_kneser_ney_matches_brute_force(spark, hot):
    """Whether all, some or no n-grams are broadcast and the others joined."""
    model, brute = quality_lm.train(spark.createDataFrame([(x,) for x in KN_TEXTS], "text string")), Kneser(KN_TEXTS)
    texts = [*KN_TEXTS, "zz!", "abba", "日 abab\nab", "abba", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = {(r._k1, r._k2): r for r in quality_lm.score(df, model, hot=hot).collect()}
    assert len(found) == len({t or "" for t in texts})
    for r in df.withColumns(quality_lm._keys(F.coalesce("text", F.lit("")))).collect():
        x, t = found[r._k1, r._k2], r.text or ""
        assert x._copies == sum((u or "") == t for u in texts) and x.n_scored == len(t) and abs(x.bits - brute.bits(t)) < 1e-2


def test_kneser_ney_sums_to_one():
    brute, seen = Kneser(KN_TEXTS), {c for t in KN_TEXTS for c in t}
    for context in ("abab", "zzzz", "\n\n\n\n", "ABC\n"):
        unseen = (0x110000 - len(seen)) * brute.p(context + "\u4e00")
        assert abs(sum(brute.p(context + c) for c in seen) + unseen - 1) < 1e-6


def test_verdicts_match_brute_force(spark):
    """Held-out documents, means, smoothing, quantiles and fall-backs, each computed again from its definition."""
    rows = [(i, words(20 + i % 30, i, 0), ("en", "de", None)[i % 3] if i % 40 else "rare", "s", None) for i in range(600)] + [(600 + i, "#" * (5 + i), "en", "s", None) for i in range(6)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(550)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0).collect()}
    good = [r for r in rows if r[0] < 550 and r[0] % 7]
    brute = Kneser([r[1] for r in good if r[0] not in held])
    bits, sample = {r[0]: brute.bits(r[1]) for r in rows}, [r for r in good if r[0] in held]
    mean = lambda own: sum(bits[r[0]] for r in own) / max(1, sum(len(r[1]) for r in own))
    by = defaultdict(list)
    for r in sample:
        by[r[2] or ""].append(r)
    means = {k: mean(v) for k, v in by.items() if len(v) >= 20}
    assert "rare" not in means and len(means) == 3
    smooth = {r[0]: (bits[r[0]] + 40 * (m := means.get(r[2] or "", mean(sample)))) / (len(r[1]) + 40) for r in rows}
    far = lambda own, q, z: float(max(np.quantile(s := [smooth[r[0]] for r in own], q), np.mean(s) + z * np.std(s, ddof=1)))
    quantiles, outer = (({k: far(by[k], q, z) for k in means}, far(sample, q, z)) for q, z in ((0.9, 1.2815515655), (0.99999, 4.264890794)))
    for r, (limit, common) in [(r, x) for q, x in ((0.9, quantiles), (0.99999, outer)) for r in quality_lm.classify(df, labels, quantile=q).collect()]:
        want = limit.get(r.lang or "", common)
        assert abs(r.log_perplexity - smooth[r.doc_id]) < 1e-4 and abs(r.threshold - want) < 1e-4
        assert abs(smooth[r.doc_id] - want) < 1e-4 or r.good == (smooth[r.doc_id] <= want)


@pytest.mark.parametrize("n", [50, 5000])
def test_one_threshold_rule_at_all_sizes(spark, n):
    """The limit is the greater of the held-out scores' quantile and a normal distribution's, few labels or many."""
    df = spark.createDataFrame([(i, words(3 + i % 5, i, 0), "en", "s", None) for i in range(n)], DOCS)
    got = quality_lm.classify(df, df.select("doc_id", F.lit(1).alias("quality")), quantile=0.99, min_trusted=5).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0).collect()
    s = [r.log_perplexity for r in got if r.held]
    assert got[0].threshold == pytest.approx(max(np.quantile(s, 0.99), np.mean(s) + 2.326347874 * np.std(s, ddof=1)), abs=1e-4)


def test_quality_classifier(spark, edge, none):
    r = random.Random(3)
    good = [(i, ". ".join("".join(r.choice("aeio") + r.choice("lnrst") for _ in range(3)) for _ in range(40)), "en", "s", None) for i in range(400)]
    junk = [(1000 + i, "".join(chr(r.randint(33, 90)) for _ in range(300)), "en", "s", None) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(None, 1, 0), (1000, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_lm.classify(clash(spark.createDataFrame(good + junk, DOCS), "bits", "threshold"), labels)
    gone = {x.doc_id for x in out.where("NOT good").collect()}
    assert gone >= set(range(1000, 1020)) and len(gone) <= 20 + len(good) // 50
    assert quality_lm.classify(edge, labels.limit(0)).where("good").count() == len(EDGE)
    assert quality_lm.classify(none, labels).count() == 0


def chain(n, seed, letters, size=60):
    """Words of which each allows a few next ones, never itself."""
    names, r = ["".join(random.Random(k).choices(letters, k=5)) for k in range(size)], random.Random(seed)
    at, out = r.randrange(size), []
    for _ in range(n):
        out.append(names[at])
        to = (at * 3 + 1 + r.randrange(3)) % size
        at = to if to != at else (to + 1) % size
    return out


def test_word_level_junk_goes(spark):
    rows, labels = [], []
    for k, letters in enumerate(("abcdefgh", "\u0431\u0432\u0433\u0434\u0436\u0437\u043a\u043b")):
        for i in range(150):
            rows.append((1000 * k + i, " ".join(chain(120, 1000 * k + i, letters)), f"l{k}", "s", None))
        for i in range(150, 160):
            t = chain(120, 1000 * k + i, letters)
            random.Random(i).shuffle(t)
            rows += [(1000 * k + i, " ".join(t), f"l{k}", "s", None), (1000 * k + i + 10, " ".join(t[:1] * 120), f"l{k}", "s", None)]
        labels += [(1000 * k + i, 1, 0) for i in range(130)]
    df, trusted = spark.createDataFrame([*rows, rows[0], rows[0]], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_lm.classify(df, trusted).collect()
    gone, junk = {x.doc_id for x in out if not x.good}, {1000 * k + i for k in (0, 1) for i in range(150, 170)}
    assert len(out) == len(rows) + 2 and gone >= junk and len(gone - junk) <= 300 // 50


# 6

def fill(budget, kids):
    """Shares of kids [(weight, capacity)] by repeated passes."""
    got = [0.0] * len(kids)
    open_, left = set(range(len(kids))), min(budget, sum(c for _, c in kids))
    while open_ and left > 1e-9:
        unit = left / sum(kids[k][0] for k in open_)
        tight = {k for k in open_ if kids[k][1] <= unit * kids[k][0] + 1e-9}
        if not tight:
            for k in open_:
                got[k] = unit * kids[k][0]
            break
        for k in tight:
            got[k] = kids[k][1]
            left -= kids[k][1]
        open_ -= tight
    return got


@pytest.mark.parametrize("fraction,epochs", [(0.3, 1), (0.9, 1), (1.5, 2)])
def test_mixing(spark, fraction, epochs):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(0, 400), r.choice(["en", "en", "en", "de", None]), f"src{min(r.randint(0, 9), r.randint(0, 9))}", None) for i in range(600)] + [(None, "n", None, None, None), (3, "again", "en", "src0", None)]
    got = mixing.decide(clash(spark.createDataFrame(rows, DOCS), "tokens", "domain", "place"), mixing.WEIGHTS, fraction, epochs).collect()
    assert len(got) == len(rows)
    leaf = defaultdict(list)
    for x in got:
        leaf[x.domain, x.lang, x.source].append(x)
    size = {k: sum(x.tokens for x in v) for k, v in leaf.items()}
    w = lambda level, v: mixing.WEIGHTS.get(level, {}).get(v, 1.0)
    total = lambda pre: sum(s for k, s in size.items() if k[: len(pre)] == pre) * epochs
    names = lambda pre: sorted({k[: len(pre) + 1] for k in size if k[: len(pre)] == pre})
    given = {(): total(()) / epochs * fraction}
    for depth, level in enumerate(mixing.LEVELS):
        for pre in [k for k in given if len(k) == depth]:
            kids = names(pre)
            given |= dict(zip(kids, fill(given[pre], [(w(level, k[-1]), total(k)) for k in kids])))
    for k, rows_ in leaf.items():
        assert abs(rows_[0].budget - given[k]) < 1.01
        e, rest = divmod(rows_[0].budget, size[k])
        place = lambda x: hashlib.md5(f"42:{e}:{'null' if x.doc_id is None else x.doc_id}".encode()).hexdigest()
        upto = 0
        for _, same in itertools.groupby(sorted(rows_, key=place), place):
            same = list(same)
            upto += sum(x.tokens for x in same)
            assert all(x.copies == e + (upto <= rest) for x in same)


def test_mixing_select(spark, edge, none):
    assert mixing.select(edge, {}, 1.0).count() == len(EDGE)
    assert mixing.select(none, {}).count() == 0 and mixing.decide(none, {}).count() == 0
    kept = mixing.select(clash(edge, "tokens"), mixing.WEIGHTS, 1.7, 2)
    assert kept.columns[-1] == "tokens" and kept.count() == mixing.decide(edge, mixing.WEIGHTS, 1.7, 2).agg(F.sum("copies")).first()[0]


def test_mixing_leaves_out_what_weighs_nothing(spark):
    """Weights of 0 at each level; siblings share the whole budget as if what weighs nothing were not there."""
    rows = [(i, "x" * (4 * (1 + i % 5)), ("en", "de", "fr")[i % 3], f"src{i % 8}", None) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"domain": {"domain0": 0.0, "domain1": 2.0}, "lang": {"de": 0.0}, "source": {"src2": -1.0}}
    got = mixing.decide(df, weights, 0.2, 1).collect()
    out = lambda r: r.domain == "domain0" or r.lang == "de" or r.source == "src2"
    assert all(r.budget == r.copies == 0 for r in got if out(r)) and any(r.copies for r in got)
    total = sum(r.tokens for r in got) * 0.2
    assert total * 0.8 < sum(r.tokens for r in got if r.copies) <= total
    assert sorted(r.doc_id for r in mixing.select(df, weights, 0.2, 1).collect()) == sorted(r.doc_id for r in got if r.copies)
    assert mixing.select(df, {"domain": {f"domain{k}": 0.0 for k in range(4)}}, 0.5, 1).count() == 0


# 7

def near_rows():
    rows, r = [], random.Random(11)
    for base in range(12):
        text = words(r.choice([30, 120, 700]), base).split()
        for v in range(r.choice([1, 3, 25])):
            t = list(text)
            for _ in range(v % 4 * max(1, len(t) // 200)):
                t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t), None, None, None))
    shared = words(60, 99)
    rows += [(len(rows) + i, shared + " " + words(150, 1000 + i), None, None, None) for i in range(20)]
    return rows + [(900, rows[0][1].upper() + "!", None, None, None), (901, "a b", None, None, None), (902, "A  b.", None, None, None), (903, "", None, None, None), (904, None, None, None, None), (905, "$$$", None, None, None), (None, "a b", None, None, None), (901, "a b", None, None, None)]


def brute_classes(rows, idf):
    ids = range(len(rows))
    sketch = list(near_dedup.shingles(pa.array([t for _, t, *_ in rows], pa.string())))
    weighed = [near_dedup.weigh(h, idf) if len(h) else None for h, _ in sketch]
    root = list(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if sketch[a][1] == sketch[b][1] or weighed[a] and weighed[b] and near_dedup.similarity(*weighed[a], *weighed[b]) >= 0.8:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(rows[i][0])
    return Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)


def test_near_dedup_equals_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, DOCS)
    idf = near_dedup.idf_weights(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 0.01)
    out = near_dedup.classes(clash(df, "node", "key", "h", "w"))
    got = Counter((r.doc_id, r.class_id) for r in out.collect())
    assert got == brute_classes([(d, t or "", *x) for d, t, *x in rows], idf)
    kept = near_dedup.drop_near_copies(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id not in (None, 901)) == sorted({c for _, c in got} - {None, 901})


def test_near_dedup_finds_plain_copies(spark, none):
    rows = [r for r in near_rows() if r[1] and len(r[1].split()) >= 30]
    grams = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) for i, t, *_ in rows if i is not None}
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    for a, b in itertools.combinations(grams, 2):
        if len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b]):
            assert cls[a] == cls[b]
        if len(grams[a] & grams[b]) < 0.3 * len(grams[a] | grams[b]):
            assert cls[a] != cls[b] or any(cls[c] == cls[a] for c in cls if c not in (a, b))
    assert near_dedup.classes(none).count() == 0


def test_one_row_of_each_class_stays(spark):
    """Repeated ids with different texts, null ids and equal rows."""
    a, b, c = (words(100, 300 + k) for k in range(3))
    rows = [(5, a), (9, a + " more"), (5, b), (3, b + " more"), (None, c), (None, c + " more"), (None, c), (7, "x y"), (7, "x y"), (7, "X y!"), (8, None), (8, "")]
    kept = near_dedup.drop_near_copies(clash(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), "h1", "top"))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and {(5, a), (3, b + " more")} <= set(got)
    assert sorted((r for r in got if r[1] not in (a, b + " more")), key=str)[0][0] == 7 and [i for i, t in got if t and t.startswith(c)] == [None] and [i for i, t in got if not t] == [8]


def test_near_copies_of_a_large_family_are_linked(spark):
    """Pairs of plain Jaccard 0.80 to 0.87 with one text, which is in a third of the rows."""
    base, rows = words(400, 77).split(), []
    for i in range(40):
        t = list(base)
        for k in range(7 + i % 2):  # an edit far from others takes five shingles
            t[20 + 45 * k + i % 13] = f"edit{i}x{k}"
        rows.append((i + 1, " ".join(t), None, None, None))
    rows = [(0, " ".join(base), None, None, None), *rows, *((100 + i, words(200, 900 + i), None, None, None) for i in range(80))]
    grams = lambda t: set(zip(*[t.split()[k:] for k in range(5)]))
    first = grams(rows[0][1])
    assert all(0.8 <= len(first & g) / len(first | g) <= 0.87 for g in (grams(r[1]) for r in rows[1:41]))
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(cls[i] == 0 for i in range(41)) and all(cls[i] == i for i in range(100, 180))


def test_unresolved_buckets_lose_no_link(spark, monkeypatch):
    """All documents in one bucket, of several classes and blocks: every link must still be found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = [(10 * k + v, " ".join(words(80, 500 + k).split()[: 80 - v]), None, None, None) for k in range(9) for v in range(4)]
    features = [(bytes([k, v]), near_dedup.weigh(next(iter(near_dedup.shingles(pa.array([rows[4 * k + v][1]]))))[0], np.ones(near_dedup.FEATURES, np.float32))) for k in range(9) for v in range(4)]
    table = spark.createDataFrame([(n, bytes((h >> np.uint64(14)).astype(np.uint32)[np.argsort((h >> np.uint64(14)).astype(np.uint32))]), bytes(w)) for n, (h, w) in features], "node binary, h binary, w binary")
    members = spark.createDataFrame([(0, n, 1, len(features)) for n, _ in features], "key long, node binary, rows long, n long")
    links = near_dedup._search(members, table, 0.8)
    labels = {bytes(r.node): bytes(r.label) for r in graph.components(links).collect()}
    assert labels == {bytes([k, v]): bytes([k, 0]) for k in range(9) for v in range(4)}


def test_block_similarity_equals_pairs():
    r = np.random.default_rng(6)
    def doc():
        h = np.unique(r.integers(0, 300, r.integers(1, 200), np.uint32))
        return h, np.where(h % 3 == 0, r.integers(1, 4, len(h)), 1 + h % 5 / 7).astype(np.float32)
    us, vs = [doc() for _ in range(7)], [doc() for _ in range(5)]
    want = [[near_dedup.similarity(*u, *v) for v in vs] for u in us]
    assert np.allclose(near_dedup.block_similarity(us, vs), want)


def test_samples_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 3000, np.uint64)
    hits, want = [], []
    for s in range(60):
        a, b = r.choice(h, 400, False), None
        b = np.concatenate([a[:300], r.choice(h, 100, False)])
        a, b = np.unique(a), np.unique(b)
        wa, wb = (1 + (x % np.uint64(5)).astype(np.float32) for x in (a, b))
        want.append(near_dedup.similarity(a, wa, b, wb))
        hits.append((near_dedup.bands(a, wa) == near_dedup.bands(b, wb)).mean())
    assert abs(np.mean(hits) - np.mean(np.array(want) ** near_dedup.ROWS)) < 0.04


def test_components(spark):
    r, n = random.Random(2), 300
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(n):
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


# 8

def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def place(key, weights, rack=4, region=2, most=4.0):
    """The shard of a key by the definition, point by point: the earliest of all regions' points that count."""
    k, n, best = mixed(xxhash.xxh64(key.encode(), seed=42).intdigest()), len(weights), (math.inf, -1)
    bounds = [(0, rack * region)]
    while bounds[-1][1] < n:
        bounds.append((bounds[-1][1], 2 * bounds[-1][1]))
    for number, (first, last) in enumerate(bounds):
        time, racks = 0.0, (last - first) // rack
        for point in itertools.count() if any(weights[first:last]) else []:
            u = [(mixed(k ^ mixed(((number << 40) + (point << 3) + what + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> 11) / 2**53 for what in range(4)]
            time -= math.log1p(-u[0]) / ((last - first) * most)
            at = first + int(u[1] * racks) * rack + int(u[2] * rack)
            if at < n and u[3] * most < weights[at]:
                best = min(best, (time, at))
                break
    return best[1]


def brute_shards(rows, n):
    """doc_id, size, checksum, shard, slot, grown shard of every (id, text)."""
    named = []
    for i, t in rows:
        key, raw = "null" if i is None else str(i), (t or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        named.append((place(key, [1.0] * n), hashlib.md5(f"{key}/{size}/{crc}".encode()).hexdigest()[0], i is not None, i or 0, crc, size, i, place(key, [1.0] * (n + 1))))
    seen, out = Counter(), Counter()
    for shard, _, _, _, crc, size, i, grown in sorted(named, key=lambda x: x[:6]):
        out[i, size, crc, shard, seen[shard], grown] += 1
        seen[shard] += 1
    return out


def test_sharding_equals_brute_force(spark, edge, none):
    """Every row: whole table of documents, and nulls, repeats and clashing columns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, clash(docs.unionByName(edge.select("doc_id", "text")), "size", "shard", "_bin", "_place")):
        got = sharding.assign(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got) == brute_shards([(r.doc_id, r.text) for r in df.collect()], 16)
        assert {r.law for r in got} == {"key"}
    assert sharding.assign(none).count() == 0


def test_sharding_grows_only_into_the_new_shard():
    """From 1 shard to 70, by steps of one; and the shares stay even."""
    keys = np.random.default_rng(1).integers(0, 2**64, 6000, np.uint64)
    rows = [sharding.places(keys, [1.0] * n).tolist() for n in range(1, 72)]
    for n in range(1, 71):
        moved = [(a, b) for a, b in zip(rows[n - 1], rows[n]) if a != b]
        assert moved and all(to == n for _, to in moved) and len({a for a, _ in moved}) >= min(n, 10)
        assert max(Counter(rows[n - 1]).values()) < 6000 / n + 6 * math.sqrt(6000 / n)


def test_a_thousand_shards_of_uneven_weights():
    r = np.random.default_rng(2)
    keys, weights = r.integers(0, 2**64, 200_000, np.uint64), r.choice([0.0, 0.5, 1.0, 4.0], 1000)
    began = time.time()
    found = np.bincount(sharding.places(keys, weights.tolist()), minlength=1000)
    assert time.time() - began < 30
    want = 200_000 * weights / weights.sum()
    assert (abs(found - want) <= 6 * np.sqrt(want)).all()
    for bad in ([], [0.0, 0.0], [-1.0, 1.0], [5.0]):
        with pytest.raises(ValueError, match="weights"):
            sharding.places(keys[:3], bad)


@pytest.mark.parametrize("weights", [[4.0] + [1.0] * 15, [1.0] * 5 + [0.0] + [1.0] * 10, [1.0] * 9 + [0.25] + [1.0] * 6])
def test_sharding_confines_moves_to_the_changed_weight(spark, weights):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    was, now = ({r.doc_id: r.shard for r in sharding.assign(rows, weights=w).collect()} for w in (None, weights))
    changed = next(s for s, w in enumerate(weights) if w != 1)
    moved = [(was[i], now[i]) for i in was if was[i] != now[i]]
    assert moved and all((to if weights[changed] > 1 else out) == changed for out, to in moved)
    assert abs(list(now.values()).count(changed) / 8000 - weights[changed] / sum(weights)) < 0.02


# 9

def test_licenses(spark, edge, none):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore", None, None, None), (2, "Intro. Released under the MIT License. End of it here", None, None, None), (3, max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len).replace(". ", ".\n"), None, None, None),
            (4, "This work is licensed under the GNU General Public License, version 2.\nLicensed under CC BY-NC 4.0.", None, None, None), (5, "a licence of no kind at all, released to you", None, None, None)]
    got = {r.doc_id: r for r in licenses.scan(clash(spark.createDataFrame(rows, DOCS), "m", "best")).collect()}
    assert [got[i].licences for i in range(1, 6)] == ["Apache-2.0", "MIT", "MIT", "CC-BY-NC-4.0,GPL-2.0", None] and [got[i].permissive for i in range(1, 6)] == [True, True, True, False, None]
    assert licenses.scan(edge).where("licences IS NULL").count() == len(EDGE) and licenses.scan(none).count() == 0


def test_license_inside_a_long_document(spark):
    """Wrapped, commented and run on licences within other text."""
    mit, gpl = (max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "GPL-3.0"))
    cut = lambda t, n, mark="": "\n".join(mark + " ".join(w[i : i + n]) for w in [t.split()] for i in range(0, len(w), n))
    inside = [cut(mit, 12), cut(gpl, 9, "# "), mit, cut(gpl, 5, " * ")]
    rows = [(i, f"{words(300, i)}\n{t} {words(300, 50 + i)}", None, None, None) for i, t in enumerate(inside)]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {0: "MIT", 1: "GPL-3.0", 2: "MIT", 3: "GPL-3.0"}


def test_license_versions_and_wrapped_texts(spark):
    """Versions are told apart; a licence wrapped at 72 columns amid other text is found."""
    import textwrap

    by = lambda name, k: [t for n, t in licenses.TEMPLATES if n == name][k]
    other = "\n".join(words(9, 900 + k) for k in range(60))
    cases = [
        (0, by("GPL-2.0", 2), "GPL-2.0"), (1, by("GPL-3.0", 2), "GPL-3.0"), (2, by("GPL-3.0", 2).replace("version 3", "version 4"), None), (3, other + "\n" + textwrap.fill(max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len), 72) + "\n" + other, "MIT"),
        (4, other + "\n# " + textwrap.fill(by("BSD-3-Clause", 1), 72).replace("\n", "\n# ") + "\n" + other, "BSD-3-Clause"), (5, textwrap.fill(by("BSD-2-Clause", 1), 60), "BSD-2-Clause"), (6, by("ISC", 0), "ISC"), (7, by("0BSD", 0), "0BSD"),
        (8, "Licensed under CC BY 3.0.", None), (9, "Licensed under CC BY 4.0", "CC-BY-4.0"), (10, other, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {i: got[i].best for i, _, _ in cases} == {i: name for i, _, name in cases}
    assert all((r.licences or "").split(",").count(r.best or "") == 1 for r in got.values())
    whole = {name for name, t in licenses.TEMPLATES if licenses.Matcher(licenses.TEMPLATES, 0.8).scan(t).get(name, 0) < 1}
    assert not whole


@pytest.mark.parametrize("fewest, most, runs", [(0, 30, 60), (30, 90, 12), (90, 1000, 3)])
def test_license_windows_equal_brute_force(fewest, most, runs):
    """Every window of every template, the long ones too, with words that repeat."""
    r, found = random.Random(5), 0
    some = [t for t in licenses.TEMPLATES if fewest <= len(t[1].split()) < most]
    m = licenses.Matcher(some, 0.8)
    for _ in range(runs):
        w = words(20, r.randrange(10**6)).split() + r.choice([[], ["the", "software"] * 6])
        for _ in range(r.randrange(1, 4) if most < 100 else 1):
            t = r.choice(some)[1].split()
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(["other", "license", "the"])
            k = r.randrange(len(w))
            w[k:k] = t
        text = " ".join(w)
        pairs = list(zip(*[re.findall(r"[^\W_]+", text.lower())[k:] for k in (0, 1)]))
        every = [(licenses.dice(set(pairs[i:j]), s), i, j, n) for _, n, s in m.sets for i in range(len(pairs)) for j in range(i + 1, min(len(pairs), i + 3 * len(s)) + 1)]
        want, counted = {}, []
        for d, i, j, n in sorted((x for x in every if x[0] >= 0.8), key=lambda x: (-x[0], x[1] - x[2])):
            # A window with idle ends is the same match as the one without them.
            own = [s for _, name, s in m.sets if name == n]
            if any(pairs[i] in s and pairs[j - 1] in s and licenses.dice(set(pairs[i:j]), s) == d and licenses.versions(s) <= set(pairs[i:j]) for s in own) and not any(a < j and i < b and (e, b - a) > (d, j - i) for e, a, b in counted):
                want[n] = max(want.get(n, 0), d)
                counted.append((d, i, j))
        assert m.scan(text) == want
        found += len(want)
    assert found >= runs


def test_license_scan_of_repeated_words_is_linear(spark):
    """A licence and 20,000 words of its own, again and again, in one text; ties of names and null ids."""
    mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    m = licenses.Matcher(licenses.TEMPLATES, 0.8)
    def took(text, want):
        began = time.time()
        assert set(m.scan(text)) == want
        return time.time() - began

    for form, want in ((lambda n: mit + " the software" * 1000 * n, {"MIT"}), (lambda n: "the software " * 1000 * n + mit, {"MIT"}), (lambda n: "the software " * 1000 * n, set()), (lambda n: (mit + " ") * n, {"MIT"})):
        assert took(form(10), want) < 20 * (took(form(2), want) + 0.1)  # ten times as long if quadratic: 25 times
    df = spark.createDataFrame([(None, "released under one licence of ours today"), (1, "released under one licence of ours today"), (1, None)], "doc_id long, text string")
    got = licenses.scan(df, templates=[("B", "released under one licence of ours"), ("A", "released under one licence of ours")]).collect()
    assert [(r.doc_id, r.licences, r.best) for r in got] == [(None, "A,B", "A"), (1, "A,B", "A"), (1, None, None)]


# 10

def test_line_rules(spark, edge, none):
    r = random.Random(9)
    rows = [(i, "\n".join(" ".join(r.choice("a b c d e f g h | #x Y! $$ ok".split()) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 8))), None, None, None) for i in range(150)]
    for d, text, got in [(x.doc_id, x.text, x) for x in spark.createDataFrame(rows + [e for e in EDGE if e[0] not in (None, 7)], DOCS).join(line_rules.judge(edge.unionByName(spark.createDataFrame(rows[11:], DOCS))), "doc_id").collect()]:
        t = text or ""
        if d < 11 and (d, text) not in {(e[0], e[1]) for e in EDGE}:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        hit = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got.n_words, got.word_chars, got.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (got.n_dup_lines, got.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert got.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert line_rules.judge(none).count() == 0 and line_rules.judge(clash(edge, "words", "lines", "sorted")).count() == len(EDGE)


def test_line_rules_verdict(spark):
    clean = "The cat sat on the mat and looked at the moon for a while.\nThen it went home."
    rows = [(1, clean), (2, "Home | About | News | Contact | Help\n" * 1 + clean), (3, "Buy$$$ now### this### thing%%% and&&& be### happy$$$ with*** it$$$ all###"), (4, "All rights reserved by the owner of this page and its many friends\n" + "Go home now."), (5, "SHOUTING ALL DAY LONG ABOUT THE THINGS THAT ARE FOR SALE HERE TODAY")]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, True, False, False, False] and got[2].clean_text == clean
