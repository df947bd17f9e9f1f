"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Words are cut at white space, lower-cased and stripped of all but letters and digits; a shingle is
five words (a shorter text is one shingle). A shingle weighs (1 + ln tf) * idf. Document frequencies
are counted over all documents in 2**18 hashed features; idf is 1 up to a share `theta` of the
documents and falls with ln(df) to 1/2 for what every document has, so that a large group of near
copies is not torn apart by its own size, while shared boilerplate still counts less.

Rows with the same words are one node, so exact copies cost one sketch and no pairs. Per node 48
consistent weighted samples form 12 bands of 4. In a bucket all nodes are compared with a leader;
where the other nodes are not one class by then, those outside the leader's class are compared with
all nodes of other classes, block by block. So every pair of a bucket is compared or already in one
class, no bucket is capped, and a bucket of copies costs only its size. A pair of blocks is one row, dealt
by bucket and block. Links have a Jaccard similarity of `similarity` or more, weighted or plain, so that a
pair of a large family, whose shared shingles weigh less, is judged as one of a small family is; classes
are their connected components, named by the smallest id.

Defined cases: a null text counts as empty; texts without words are classes by equal text; rows with
a null id belong to a class but do not name it, and class_id is null where all ids are; rows that
repeat an id are judged by their own text; `drop_near_copies` keeps exactly one row of each class; an empty
table gives an empty result; other columns are ignored by `classes` and kept by `drop_near_copies`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.memory import trim
from lodestone.llm.skew import join_groups
from lodestone.tables import materialize

SHINGLE, BANDS, ROWS = 5, 12, 4
FEATURES = 1 << 18
#: Shingles times samples that are evaluated at once; bounds a worker's memory.
CHUNK = 20_000
#: Nodes and bytes of shingles of one block, about.
BLOCK, BLOCK_BYTES = 128, 1 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(20240607)
_WORD_KEYS = _rng.integers(1, 2**63, SHINGLE, np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 2**63, BANDS * ROWS, np.uint64)
_BAND_KEYS = _rng.integers(1, 2**63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal parts, by bisection."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = -np.expm1(-x) - x * np.exp(-x) < u
        low, high = np.where(under, x, low), np.where(under, high, x)
    return low.astype(np.float32)


_R = _gamma2()
_LOG_C = np.log(_R)
_NOT_WORD = re.compile(r"[\W_]+")


def shingles(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Per text its shingle hashes, repeated as often as they occur, and 16 bytes that stand for its words."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    table = split.flatten().dictionary_encode()
    names = [_NOT_WORD.sub("", w.lower()) for w in table.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in names], np.uint64)
    words = hashes[np.asarray(table.indices)] if len(names) else np.zeros(0, np.uint64)
    full = np.array([bool(w) for w in names], bool)[np.asarray(table.indices)] if len(names) else np.zeros(0, bool)
    offsets = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py() if len(split) else np.zeros(1, np.int64)
    for i in range(len(texts)):
        own = words[offsets[i] : offsets[i + 1]][full[offsets[i] : offsets[i + 1]]]
        if not len(own):
            yield own, xxhash.xxh128_digest(texts[i].as_py() or "", seed=1)
            continue
        n = max(1, len(own) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(own))):
            total += own[k : k + n] * _WORD_KEYS[k]
        yield _mix(total + np.uint64(min(SHINGLE, len(own)))), xxhash.xxh128_digest(own.tobytes())


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def weigh(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their weights."""
    distinct, tf = np.unique(h, return_counts=True)
    return distinct, ((1 + np.log(tf)) * idf[_feature(distinct)]).astype(np.float32)


def bands(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bucket keys of the bands, from one consistent weighted sample per seed."""
    best, sample = np.full(len(_SEEDS), np.inf, np.float32), np.zeros(len(_SEEDS), np.uint64)
    log_w, rows = np.log(w), np.arange(len(_SEEDS))
    for at in range(0, len(h), CHUNK):
        part, lw = h[at : at + CHUNK], log_w[at : at + CHUNK]
        x = _mix((part ^ _SEEDS[:, None]) * _M1)
        r, beta = _R[x & np.uint64(0xFFFF)], ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        a = _LOG_C[(x >> np.uint64(16)) & np.uint64(0xFFFF)]
        t = np.floor(lw / r + beta) if lw.any() else np.float32(0)
        a = a - r * (t - beta + 1)
        k = np.argmin(a, axis=1)
        better = a[rows, k] < best
        step = t[rows, k] if np.ndim(t) else np.zeros(len(rows), np.float32)
        best = np.where(better, a[rows, k], best)
        sample = np.where(better, _mix(part[k] + step.astype(np.int64).astype(np.uint64) * _M1), sample)
    return _mix((sample.reshape(BANDS, ROWS) * _BAND_KEYS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """The greater of weighted and plain Jaccard of two sorted shingle sets."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    weighted = both / max(1e-9, float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)
    return max(weighted, len(i) / max(1, len(ha) + len(hb) - len(i)))


def idf_weights(docs: DataFrame, theta: float) -> np.ndarray:
    """The weight of each hashed feature, from its document frequency: 2**18 numbers at any size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for h, _ in shingles(batch.column(0)):
                df[np.unique(_feature(h))] += 1
                n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["feature", "df"])

    counts = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    counts = materialize(counts, "df")
    n = (counts.where("feature = -1").agg(F.sum("df")).first()[0]) or 0
    common = counts.where((F.col("feature") >= 0) & (F.col("df") > theta * n)).toPandas()
    idf = np.ones(FEATURES, np.float32)
    idf[common["feature"].to_numpy(np.int64)] = 0.5 + 0.5 * np.log(n / np.minimum(common["df"].to_numpy(np.float64), n)) / np.log(1 / theta)
    return idf


def _verified(pairs: DataFrame, features: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of similarity `least` or more."""
    side = lambda c: features.select(F.col("node").alias(c), F.col("h").alias(f"h_{c}"), F.col("w").alias(f"w_{c}"))
    joined = pairs.select("u", "v").join(side("v"), "v").join(side("u"), "u").select("u", "v", "h_u", "w_u", "h_v", "w_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h_u, w_u, h_v, w_v = (batch.column(c) for c in ("h_u", "w_u", "h_v", "w_v"))
            read = lambda c, i, kind: np.frombuffer(c[i].as_buffer(), kind)
            ok = [similarity(read(h_u, i, np.uint32), read(w_u, i, np.float32), read(h_v, i, np.uint32), read(w_v, i, np.float32)) >= least - 1e-6 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "u binary, v binary")


def _sketches(docs: DataFrame, shared) -> DataFrame:
    """doc_id, h1, h2, node, keys for every row of docs; no keys for a text of no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, last = shared.value, (b"", [])
        for batch in batches:
            nodes, keys = [], []
            for h, node in shingles(batch.column("text")):
                if node != last[0]:
                    last = node, (bands(*weigh(h, idf)).view(np.int64).tolist() if len(h) else [])
                nodes.append(node)
                keys.append(last[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "node", "keys"])
            trim()

    return docs.select("doc_id", "text", "h1", "h2").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, node binary, keys array<long>")


def _features(docs: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """node, h, w of the wanted nodes (node, top: the row to read): sorted 32-bit shingle hashes and weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wants, (h, node) in zip(batch.column("node").to_pylist(), shingles(batch.column("text"))):
                if node == wants:
                    h, w = weigh(h, shared.value)
                    short, first = np.unique((h >> np.uint64(14)).astype(np.uint32), return_index=True)
                    out.append((node, short.tobytes(), w[first].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(3)], names=["node", "h", "w"])

    rows = docs.withColumns(_text_hashes("text"))
    wanted = wanted.select("node", F.col("top.doc_id").alias("id"), F.col("top.h1").alias("k1"), F.col("top.h2").alias("k2"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("node", "text")
    return texts.mapInArrow(run, "node binary, h binary, w binary").dropDuplicates(["node"])


def block_similarity(us: list[tuple[np.ndarray, np.ndarray]], vs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """`similarity` of all pairs of two blocks, as sums of matrix products over shared shingles."""
    flat = lambda side: (np.concatenate([h for h, _ in side]), np.repeat(np.arange(len(side)), [len(h) for h, _ in side]), np.concatenate([w for _, w in side]))
    (hu, iu, wu), (hv, iv, wv) = flat(us), flat(vs)
    common = np.intersect1d(hu, hv)
    both, plain = np.zeros((len(us), len(vs))), np.zeros((len(us), len(vs)))
    if len(common):
        (cu, iu, wu_), (cv, iv, wv_) = ((np.searchsorted(common, h[m]), i[m], w[m]) for h, i, w in ((hu, iu, wu), (hv, iv, wv)) for m in [np.isin(h, common)])
        low, high = np.full(len(common), np.inf), np.zeros(len(common))
        for c, w in ((cu, wu_), (cv, wv_)):
            np.minimum.at(low, c, w)
            np.maximum.at(high, c, w)
        even = high - low < 1e-6  # one weight everywhere: the smaller of two is their common one
        for at in range(0, len(common), 4096):
            a, b = np.zeros((len(us), 4096)), np.zeros((len(vs), 4096))
            for side, c, i, w in ((a, cu, iu, wu_), (b, cv, iv, wv_)):
                m = (c >= at) & (c < at + 4096) & even[c]
                side[i[m], c[m] - at] = np.sqrt(low[c[m]])
            both += a @ b.T
            a, b = np.zeros((len(us), 4096), np.float32), np.zeros((len(vs), 4096), np.float32)
            for side, c, i in ((a, cu, iu), (b, cv, iv)):
                m = (c >= at) & (c < at + 4096)
                side[i[m], c[m] - at] = 1
            plain += a @ b.T
        for c in np.flatnonzero(~even):
            a, b = np.zeros(len(us)), np.zeros(len(vs))
            a[iu[cu == c]], b[iv[cv == c]] = wu_[cu == c], wv_[cv == c]
            both += np.minimum.outer(a, b)
    total = np.array([w.sum(dtype=np.float64) for _, w in us])[:, None] + np.array([w.sum(dtype=np.float64) for _, w in vs])[None, :]
    sizes = np.array([len(h) for h, _ in us])[:, None] + np.array([len(h) for h, _ in vs])[None, :]
    return np.maximum(both / np.maximum(total - both, 1e-9), plain / np.maximum(sizes - plain, 1))


def _compared(open_: DataFrame, features: DataFrame, least: float) -> DataFrame:
    """Links between the nodes outside their bucket's main class and all nodes of other classes, from
    open_(key, node, label, main). Buckets are cut into blocks by a hash, so a task holds two blocks
    whatever the bucket's size; of a node's links into one class and block the first is enough."""
    full = materialize(open_.join(features, "node").select("key", "label", "main", F.struct("node", "label", "h", "w").alias("x"), F.octet_length("h").alias("size")), "open")
    total = full.count()
    need = lambda some, n: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.when(some, F.col("size"))) / BLOCK_BYTES, F.count_if(some) / BLOCK))).alias(n)
    minor = F.col("label") != F.col("main")
    sizes = materialize(full.groupBy("key").agg(need(minor, "u_blocks"), need(F.lit(True), "v_blocks"), F.count(F.lit(1)).alias("n")), "blocks")
    # A bucket may hold most rows, so they are dealt by bucket and block, never by bucket alone.
    dealt = join_groups(full, sizes, ["key"], "n", total)

    def blocks(rows: DataFrame, n: str, name: str) -> DataFrame:
        placed = rows.select("key", "x", "v_blocks", F.pmod(F.xxhash64("x.node"), F.col(n)).alias("block"))
        return placed.repartition("key", "block").groupBy("key", "block").agg(F.collect_list("x").alias(name), F.max("v_blocks").alias("v_blocks"))

    us = blocks(dealt.where(minor), "u_blocks", "us").select("key", "us", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_blocks") - 1)).alias("block"))
    pairs = us.join(blocks(dealt, "v_blocks", "vs").drop("v_blocks"), ["key", "block"]).select("us", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = lambda x: [(np.frombuffer(y["h"], np.uint32), np.frombuffer(y["w"], np.float32)) for y in x]
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                us, vs = batch.column("us")[k].as_py(), batch.column("vs")[k].as_py()
                fu, fv = side(us), side(vs)
                for i, row in enumerate(block_similarity(fu, fv)):
                    seen = set()
                    for j in np.flatnonzero(row >= least - 1e-4):
                        if vs[j]["label"] != us[i]["label"] and vs[j]["label"] not in seen and similarity(*fu[i], *fv[j]) >= least - 1e-6:
                            seen.add(vs[j]["label"])
                            out.append((us[i]["node"], vs[j]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], names=["u", "v"])

    return pairs.mapInArrow(run, "u binary, v binary")


def _search(members: DataFrame, features: DataFrame, least: float) -> DataFrame | None:
    """Links between nodes that share a bucket, from members(key, node, rows, n: the bucket's nodes), enough of
    them for the same components as all links have; None where no bucket has two nodes. A bucket's leader is
    the node of most rows, then of the largest buckets, which tends to be the text that others derive from."""
    total = members.count()
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("rows", "central", "node")).alias("top"), F.max("n").alias("n"))
    leaders = materialize(leaders.select("key", F.col("top.node").alias("leader"), "n"), "leaders")
    followers = materialize(join_groups(members.drop("n"), leaders, ["key"], "n", total).where("node <> leader").select("key", "node", "leader"), "followers")
    if followers.isEmpty():
        return None
    links = materialize(_verified(followers.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), features, least), "links")
    # A leader has met its whole bucket. The others are compared unless they are one class by now.
    labels = materialize(components(links), "labels")
    named = followers.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "leader")
    named = named.join(labels.select(F.col("node").alias("leader"), F.col("label").alias("main")), "leader", "left").select("key", "node", "label", F.coalesce("main", "leader").alias("main"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
    more = _compared(join_groups(named, materialize(mixed, "mixed"), ["key"], "n", total).drop("n"), features, least)
    return materialize(links.unionByName(more), "links")


def _labelled(docs: DataFrame, similarity: float, theta: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, text hashes h1 and h2, and node of every row of docs(doc_id, text); node, rep_id, rows, top
    (its first row by id, null last, and text) and label (one per class) of every node."""
    shared = docs.sparkSession.sparkContext.broadcast(idf_weights(docs, theta))
    sketches = materialize(_sketches(docs.withColumns(_text_hashes("text")), shared), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "h1", "h2")
    nodes = materialize(sketches.groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("rows"), F.any_value("keys").alias("keys"), F.min(first).alias("top")), "nodes")
    buckets = nodes.select(F.explode("keys").alias("key"), "node", "rows")
    full = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialize(buckets.join(full, "key"), "members")
    wanted = nodes.select("top", "node").join(members.select("node").distinct(), "node", "left_semi")
    features = materialize(_features(docs, wanted, shared), "features")
    links = _search(members, features, similarity)
    named = nodes.select("node", "rep_id", "rows", "top")
    if links is None:
        return sketches, named.withColumn("label", F.col("node"))
    labels = materialize(components(links), "labels")
    return sketches, materialize(named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def _text_hashes(text: str) -> dict:
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, theta: float = 0.01) -> DataFrame:
    """doc_id, class_id, kept for every row of `df`."""
    sketches, nodes = _labelled(_docs(df, id_col, text_col), similarity, theta)
    names = nodes.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    named = materialize(nodes.select("node", "label", "rows").join(names, "label").select("node", "class_id", "rows"), "classes")
    return join_groups(sketches.select("doc_id", "node"), named, ["node"], "rows", sketches.count()).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, theta: float = 0.01) -> DataFrame:
    """One row of `df` of each class: of the smallest id, where rows with a null id come last, then by text."""
    _, nodes = _labelled(_docs(df, id_col, text_col), similarity, theta)
    tops = materialize(nodes.groupBy("label").agg(F.min("top").alias("top")).select(F.col("top.doc_id").alias("_id"), F.col("top.h1").alias("_h1"), F.col("top.h2").alias("_h2")), "tops")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The input's row is one value until the end, so its columns meet none of these names.
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("_own_id"), F.xxhash64(text).alias("_own_h1"), F.xxhash64(F.lit(1), text).alias("_own_h2"))
    kept = rows.join(tops, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_h1") == F.col("_h1")) & (F.col("_own_h2") == F.col("_h2")), "left_semi")
    return kept.dropDuplicates(["_own_id", "_own_h1", "_own_h2"]).select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
