"""Quality classifier by an interpolated modified Kneser-Ney model of character n-grams.

Trusted text is counted in n-grams of ORDER real characters (code points as they are, no classes), the
start of a text being newlines. Lower orders count distinct continuations; totals, discounts and lower
probabilities meet in joins by n-gram, each order written once, so the model is a table that grows with
the trusted text. -log2 of a character's probability is additive over what the model holds:

    n-gram g of order k    -log2 p_k(g) + log2 l_k(context) + log2 p_k-1(suffix)
    context u of order k   -log2 l_k+1(u)

and every character costs the uniform share of the code points and the empty context besides, so an n-gram
that is not in the model needs no row: what is left is the back-off. The at most `hot` most frequent
n-grams are a broadcast that tasks add up at once. All others are joined, sharded by n-gram, with the
documents' n-grams that a bitmap of the model's (2**26 bits at any size) does not rule out, and summed by text.

A document's score is its mean bits per character (log perplexity), drawn towards its language's mean as
if `prior_chars` more characters had been read, so that a short text is not rejected by chance. A
language's threshold is the `quantile` of the scores of a fifth of its trusted documents, or that of the normal
distribution with their mean and deviation where it is greater, as few scores do not reach as far. The model is
trained on the others, so the threshold is what unseen text of its kind scores.

Trusted are all documents labelled with quality 1; counts cover their whole texts. Up to `few_ids` labelled
ids are broadcast. Of more, a bitmap rules out most other documents, and what is left meets the ids by a shuffle.

Defined cases: a null or empty text has its language's mean score, so it stays; a null language is a
language of its own; languages with fewer than `min_trusted` held-out documents take the threshold of all
languages; without trusted documents everything stays; null ids are unlabelled; repeated rows are scored
row by row; other columns pass through, except those of the result's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.memory import trim
from lodestone.llm.skew import join_groups
from lodestone.tables import materialize

ORDER = 5
#: N-grams of the broadcast, at most: 20 bytes each.
HOT = 1 << 18
#: Bits of the map of the model's other n-grams.
MAP_BITS = 26
#: The uniform distribution that the lowest order backs off to: over all code points.
UNIFORM = 1.0 / 0x110000
#: Characters that a task turns into numbers at once; bounds its memory.
CHUNK = 1_000_000

_BASE, _MIX, _TAG = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), 0x94D049BB133111EB
_POWERS = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(ORDER)]
_TAGS = [np.uint64(k * _TAG % (1 << 64)) for k in range(ORDER + 1)]
_PAD = "\n" * (ORDER - 1)


def _names(codes: np.ndarray) -> list[np.ndarray]:
    """64-bit names of the n-grams of orders 1 to ORDER that end at each character."""
    total, out = np.zeros(len(codes), np.uint64), []
    for k in range(1, ORDER + 1):
        total[k - 1 :] += codes[: max(0, len(codes) - k + 1)] * _POWERS[k - 1]
        x = (total + _TAGS[k]) * _MIX
        x ^= x >> np.uint64(31)
        out.append(x * _POWERS[1])
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Chunk:
    """Some texts, each after its padding: n-grams by their last character, its text, and where texts' own are."""

    def __init__(self, texts: list[str]):
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = _codes([x for t in texts for x in (_PAD, t)])
        self.text = np.repeat(np.arange(len(texts)), lengths + ORDER - 1)
        starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
        own = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            own[starts + k] = False
        self.at = np.flatnonzero(own)
        self.names = _names(codes)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and end of runs of about CHUNK characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_ngrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n of the n-grams of order ORDER; tasks send each n-gram of a run of texts once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in _chunks(texts):
                chunk, joined = Chunk(texts[start:end]), "".join(x for t in texts[start:end] for x in (_PAD, t))
                _, first, n = np.unique(chunk.names[-1][chunk.at], return_index=True, return_counts=True)
                grams = [joined[i - ORDER + 1 : i + 1] for i in chunk.at[first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n.astype(np.int64))], names=["gram", "n"])
            trim()

    return df.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's D1, D2, D3+ from the counts of counts; 0.75 of a count where these lack."""
    n = [float(x or 0) for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in range(1, 5)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), k) if n[k - 1] and n[k] else 0.75 for k in (1, 2, 3)]


def train(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The model: gram, seen (occurrences), gram_bits, context_bits, and total (of order ORDER: the bits of
    its last character); the empty gram's context_bits are the empty context's. Each order is one table."""
    tables = {ORDER: materialize(count_ngrams(df, text_col).withColumn("seen", F.col("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        above = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram"))
        tables[k] = materialize(above.agg(F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen")), "grams")
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = tables[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("off", off)
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("spared"), F.sum("seen").alias("met")).withColumn("l", F.col("spared") / F.col("total"))
        rows = rows.join(contexts.select("context", "total", "l"), "context")
        rows = rows.withColumn("q", F.lit(UNIFORM)) if lower is None else rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), F.substring("gram", 2, k - 1) == F.col("suffix"))
        p = F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total") + F.col("l") * F.col("q")
        lower = materialize(rows.select("gram", "seen", p.alias("p"), "q", "l"), "order")
        bits = -F.log2("p")
        parts.append(lower.select("gram", "seen", (bits + F.log2("l") + F.log2("q")).alias("gram_bits"), F.lit(0.0).alias("context_bits"), (bits if k == ORDER else F.lit(None).cast("double")).alias("total")))
        parts.append(contexts.select(F.col("context").alias("gram"), F.col("met").alias("seen"), F.lit(0.0).alias("gram_bits"), (-F.log2("l")).alias("context_bits"), F.lit(None).cast("double").alias("total")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    merged = model.groupBy("gram").agg(F.max("seen").alias("seen"), F.sum("gram_bits").alias("gram_bits"), F.sum("context_bits").alias("context_bits"), F.max("total").alias("total"))
    return materialize(merged, "model")


@F.pandas_udf(T.LongType())
def name_of(grams: pd.Series) -> pd.Series:
    """The 64-bit name of an n-gram, from its characters."""
    out, sizes = np.zeros(len(grams), np.int64), grams.str.len().to_numpy()
    for k in np.unique(sizes):
        own = np.flatnonzero(sizes == k)
        out[own] = _names(_codes(grams.iloc[own].tolist()))[k - 1][k - 1 :: k].view(np.int64)
    return pd.Series(out)


def bitmap(named: DataFrame) -> np.ndarray:
    """2**MAP_BITS bits, those of the 64-bit names in `name` set."""
    slot = F.shiftrightunsigned("name", 64 - MAP_BITS)
    words = named.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(name, {64 - MAP_BITS}) & 63 as int)))").alias("bits")).toArrow().to_pandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_map(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    slot = names >> np.uint64(64 - MAP_BITS)
    return ((known[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


class Hot:
    """The broadcast part of the model: the names of order ORDER and their bits, those of lower orders
    and their two values, a bitmap of all other names, and what every character costs besides."""

    def __init__(self, model: DataFrame, hot: int):
        empty = model.where("gram = ''").select("context_bits").first()
        self.each = float(-np.log2(UNIFORM)) + (float(empty[0]) if empty else 0.0)
        named = materialize(model.where("gram <> ''").withColumn("name", name_of("gram")).drop("gram"), "named")
        sizes = named.groupBy("seen").agg(F.count(F.lit(1)).alias("rows")).toArrow().to_pandas().sort_values("seen", ascending=False)
        fit = sizes["seen"][(sizes["rows"].cumsum() <= hot).to_numpy()]
        least = int(fit.min()) if len(fit) else 1 << 62
        single = [F.col(c).cast("float") for c in ("gram_bits", "context_bits", "total")]
        near = named.where(F.col("seen") >= least).select("name", *single).toArrow().to_pandas()
        self.rest = named.where(F.col("seen") < least).select("name", "gram_bits", "context_bits")
        near["name"] = near["name"].to_numpy(np.int64).view(np.uint64)
        near = near.sort_values("name")
        top, low = near[near["total"].notna()], near[near["total"].isna()]
        self.top = top["name"].to_numpy(np.uint64), top["total"].to_numpy(np.float32)
        self.low = low["name"].to_numpy(np.uint64), low["gram_bits"].to_numpy(np.float32), low["context_bits"].to_numpy(np.float32)
        self.map = bitmap(self.rest)

    def shared(self) -> tuple:
        return self.each, self.top, self.low, self.map


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `names`, and which are there."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(names, wanted)
    at[at == len(names)] = 0
    return at, names[at] == wanted


def _near_and_far(texts: list[str], shared: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text by the broadcast part, and what is left to join: rows of (t, name, grams, contexts)."""
    each, (top, total), (low, gram_bits, context_bits), known = shared
    kind = [("t", np.int64), ("name", np.uint64), ("grams", np.int32), ("contexts", np.int32)]
    chunk, left = Chunk(texts), []
    at, found = _find(top, chunk.names[-1][chunk.at])
    bits = np.zeros(len(texts))
    if found.any():
        bits += np.bincount(chunk.text[chunk.at[found]], total[at[found]], len(texts))
    open_ = chunk.at[~found]
    bits += each * np.bincount(chunk.text[open_], minlength=len(texts))

    def look(names: np.ndarray, values: np.ndarray | None, column: str) -> None:
        nonlocal bits
        place, here = _find(low, names) if values is not None else (None, np.zeros(len(names), bool))
        if here.any():
            bits = bits + np.bincount(chunk.text[open_[here]], values[place[here]], len(texts))
        cold = ~here & _in_map(known, names)
        rows = np.zeros(int(cold.sum()), kind)
        rows["t"], rows["name"], rows[column] = chunk.text[open_[cold]], names[cold], 1
        left.append(rows)

    look(chunk.names[-1][open_], None, "grams")
    for k in range(ORDER - 1):
        look(chunk.names[k][open_], gram_bits, "grams")
        look(chunk.names[k][open_ - 1], context_bits, "contexts")
    rows = np.concatenate(left)
    rows = rows[np.lexsort((rows["name"], rows["t"]))]
    first = np.flatnonzero(np.append(True, (rows["t"][1:] != rows["t"][:-1]) | (rows["name"][1:] != rows["name"][:-1]))) if len(rows) else np.zeros(0, np.int64)
    out = rows[first]
    if len(rows):
        out["grams"], out["contexts"] = np.add.reduceat(rows["grams"], first), np.add.reduceat(rows["contexts"], first)
    return bits, out


def _keys(text: Column) -> dict[str, Column]:
    return {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)}


def score(df: DataFrame, model: DataFrame, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """_k1, _k2 (the text's keys), _copies (its rows), n_scored (characters), bits: one row per text of `df`."""
    part = Hot(model, hot)
    shared = df.sparkSession.sparkContext.broadcast(part.shared())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in _chunks(texts):
                bits, far = _near_and_far(texts[start:end], shared.value)
                offsets = np.searchsorted(far["t"], np.arange(end - start + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(far["name"].view(np.int64)), pa.array(far["grams"]), pa.array(far["contexts"])], ["name", "grams", "contexts"])
                cold = pa.ListArray.from_arrays(pa.array(offsets), struct)
                n = np.array([len(t) for t in texts[start:end]], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], batch.column(1)[start:end], pa.array(n), pa.array(bits), cold], names=["_k1", "_k2", "n_scored", "bits", "cold"])
            trim()

    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = "_k1 long, _k2 long, n_scored long, bits double, cold array<struct<name:long,grams:int,contexts:int>>"
    near = materialize(df.select(*[c.alias(k) for k, c in _keys(text).items()], text).mapInArrow(run, schema), "near")
    cold = near.select("_k1", "_k2", F.inline("cold")).join(part.rest.hint("merge"), "name")
    far = cold.groupBy("_k1", "_k2").agg(F.sum(F.col("grams") * F.col("gram_bits") + F.col("contexts") * F.col("context_bits")).alias("far"))
    # Equal texts have one key and add up, so the sum is divided by how many there are.
    texts = near.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_copies"), F.max("n_scored").alias("n_scored"), F.max("bits").alias("bits")).join(far, ["_k1", "_k2"], "left")
    return materialize(texts.select("_k1", "_k2", "_copies", "n_scored", F.round(F.col("bits") + F.coalesce("far", F.lit(0.0)) / F.col("_copies"), 3).alias("bits")), "scored")


def trusted_ids(labels: DataFrame, kind: T.DataType) -> DataFrame:
    """All labelled ids, once each."""
    return materialize(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast(kind).alias("_trusted")).where("_trusted IS NOT NULL").distinct(), "trusted")


def among(rows: DataFrame, ids: DataFrame, few_ids: int) -> DataFrame:
    """The rows whose `_id` is one of `ids`; only few ids are broadcast, as a bitmap of fixed size is of many."""
    same = F.col("_id") == F.col("_trusted")
    if ids.limit(few_ids + 1).count() <= few_ids:
        return rows.join(F.broadcast(ids), same, "left_semi")
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("_trusted").alias("name"))))

    def run(names: pa.Array) -> pa.Array:
        return pa.array(_in_map(shared.value, np.asarray(names).view(np.uint64)))

    return rows.where(F.arrow_udf(run, T.BooleanType())(F.xxhash64("_id"))).join(ids.hint("merge"), same, "left_semi")


def quantiles(rows: DataFrame, q: float, by: str) -> DataFrame:
    """by, _quantile: the exact, interpolated quantile of `s`, which has 6 digits. No task holds a group: rows are counted by
    value, the values by hundredths, and only the hundredths about the place (10,000 values each) are looked at."""
    values = materialize(rows.groupBy(by, "s").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("s") * 100)), "values")

    def before(n: str, order: str, *keys: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    bins = values.groupBy(by, "bin").agg(F.sum("n").alias("m"))
    bins = bins.withColumn("start", before("m", "bin", by)).withColumn("at", (F.sum("m").over(Window.partitionBy(by)) - 1) * F.lit(q))
    near = bins.where((F.col("start") <= F.ceil("at")) & (F.col("start") + F.col("m") > F.floor("at")))
    placed = values.join(near, [by, "bin"]).withColumn("first", F.col("start") + before("n", "s", by, "bin"))
    at = lambda place: F.max(F.when((F.col("first") <= place) & (F.col("first") + F.col("n") > place), F.col("s")))
    ends = placed.groupBy(by).agg(at(F.floor("at")).alias("low"), at(F.ceil("at")).alias("high"), F.max(F.col("at") - F.floor("at")).alias("share"))
    return ends.select(by, ((1 - F.col("share")) * F.col("low") + F.col("share") * F.col("high")).alias("_quantile"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.999,
             prior_chars: int = 40, min_trusted: int = 20, few_ids: int = 1_000_000, hot: int = HOT, keep: list[str] | None = None) -> DataFrame:
    """`df`, or its columns `keep`, with n_scored, bits, log_perplexity (bits a character), threshold and `good`: not over it."""
    df = df.drop("n_scored", "bits", "log_perplexity", "threshold", "good")
    ids = trusted_ids(labels, df.schema[id_col].dataType)
    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = F.pmod(F.xxhash64("_id", F.lit("held out")), F.lit(5)) == 0
    scored = score(df, train(among(given.where(~held_out).select("_id", "text"), ids, few_ids), "text"), text_col, hot)
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("_lang")
    keys = _keys(F.coalesce(F.col(text_col), F.lit("")))
    held = among(given.where(held_out).select("_id", F.coalesce("lang", F.lit("")).alias("_lang"), *[c.alias(k) for k, c in _keys(F.coalesce("text", F.lit(""))).items()]), ids, few_ids)
    sample = materialize(held.join(scored.select("_k1", "_k2", "n_scored", "bits"), ["_k1", "_k2"]).select("_lang", "n_scored", "bits"), "held")
    per_char = F.sum("bits") / F.greatest(F.sum("n_scored"), F.lit(1))
    means = sample.groupBy("_lang").agg(per_char.alias("_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_trusted)
    overall = sample.agg(per_char.alias("m")).first()["m"]
    mean = F.coalesce(F.col("_mean"), F.lit(overall))
    smooth = F.round((F.col("bits") + prior_chars * mean) / (F.col("n_scored") + prior_chars), 6)
    judged = sample.join(F.broadcast(means), "_lang", "left").select("_lang", "_mean", "_n", smooth.alias("s"))
    normal = F.avg("s") + NormalDist().inv_cdf(quantile) * F.coalesce(F.stddev_samp("s"), F.lit(0.0))
    limit = F.greatest("_quantile", "_normal")
    own = judged.where("_n IS NOT NULL")
    limits = own.groupBy("_lang", "_mean").agg(normal.alias("_normal")).join(quantiles(own, quantile, "_lang"), "_lang").select("_lang", "_mean", limit.alias("_limit"))
    every = judged.withColumn("_lang", F.lit(""))
    common = every.groupBy("_lang").agg(normal.alias("_normal")).join(quantiles(every, quantile, "_lang"), "_lang").select(limit).first()
    common = common[0] if common else None
    # A language with a limit has min_trusted held-out documents, so the languages are few and texts need no shuffle to meet theirs.
    # The input's row is one value until the end, so its columns meet none of these names.
    kept = df.columns if keep is None else keep
    rows = df.select(F.struct(*kept).alias("_row"), lang, *[c.alias(k) for k, c in keys.items()])
    rows = join_groups(rows, scored, ["_k1", "_k2"], "_copies", df.count()).join(F.broadcast(limits), "_lang", "left")
    rows = rows.withColumn("log_perplexity", smooth).withColumn("threshold", F.round(F.coalesce(F.col("_limit"), F.lit(common).cast("double")), 6))
    good = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in kept], "n_scored", "bits", "log_perplexity", "threshold", good.alias("good"))
