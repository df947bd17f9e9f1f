"""Exact vector retrieval.

A stated set of queries is compared with all rows. Queries go in blocks of about BLOCK, which is the bound of
what the driver and a broadcast hold; each block is one pass over the vectors. A task keeps a running k best
of its rows for each query and emits them at its end, so what is shuffled is k rows a query and task. A task
multiplies as many rows at once as make CELLS scores with the block, so its memory is alike for few queries and many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import vectors
from lodestone.tables import materialize

BLOCK = 4096
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Labels whose centroids a task holds.
MOST_LABELS = 10_000


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, as doubles."""
    flat = np.asarray(column.flatten().cast(pa.float64()), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def dot(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded inner products of two columns of vectors of one length, neither null, by Arrow batches."""
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(np.round(np.einsum("ij,ij->i", matrix(x), matrix(y)), digits))

    return F.arrow_udf(run, T.DoubleType())(a, b)


def best(df: DataFrame, k: int, *by: str, score: str = "score", id_col: str = "vec_id") -> DataFrame:
    """The k best rows of each group by (score desc, id), with their rank from 1."""
    order = W.partitionBy(*by).orderBy(F.desc(score), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(queries: DataFrame) -> Iterator[list]:
    """The rows of `queries` in blocks of about BLOCK by a hash of query_id, each read when its turn comes."""
    n = -(-2 * queries.count() // BLOCK) or 1
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).orderBy("query_id").collect()


def _passes(queries: DataFrame, one: Callable[[list], DataFrame], name: str) -> DataFrame:
    """The union of one pass a block; several are written as they end, so the plan stays small."""
    parts = []
    for rows in blocks(queries):
        if parts:
            parts[-1] = materialize(parts[-1], name)
        parts.append(one(rows))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scores(q: np.ndarray, v: np.ndarray, metric: str, digits: int) -> np.ndarray:
    s = q @ v.T if metric == "ip" else -((q**2).sum(1)[:, None] - 2 * q @ v.T + (v**2).sum(1)[None, :])
    return np.round(s, digits) + 0.0  # no zero is negative


def _parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most CELLS scores with n queries; nothing without queries."""
    step = max(1, CELLS // max(1, n))
    for batch in batches if n else ():
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class Best:
    """The k best (score, then smaller id) of what each query has met, with a further number of each where `also` has one; `edge`
    is the last of k."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids, self.also, self.edge = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n, np.full(n, -np.inf)

    def meet(self, s: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None, also: np.ndarray | None = None) -> None:
        in_reach = (s >= self.edge[:, None]) | np.isneginf(self.edge)[:, None]
        if allowed is not None:
            in_reach &= allowed
        for i in np.flatnonzero(in_reach.any(1)):
            row, new = s[i], in_reach[i]
            score, name = np.append(self.scores[i], row[new]), np.append(self.ids[i], ids[new])
            more = None if also is None else np.append(self.also[i], also[i][new])
            if len(score) > self.k:  # ties at the edge stay until ids settle them
                near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                score, name, more = score[near], name[near], None if more is None else more[near]
            order = np.lexsort((name, -score))[: self.k]
            self.scores[i], self.ids[i] = score[order], name[order]
            if more is not None:
                self.also[i] = more[order]
            if len(order) == self.k:
                self.edge[i] = score[order[-1]]


def topk(vecs: DataFrame, queries: DataFrame, k: int, metric: str = "ip", split_col: str | None = None, digits: int = 6) -> DataFrame:
    """(query_id, [split], vec_id, score, rank): exact top k of vecs(vec_id, v) for queries(query_id, q).
    metric: 'ip' inner product, 'l2' negated squared distance. Scores are rounded before ranking. Null vectors,
    of rows or queries, meet nothing."""
    keys = [split_col] if split_col else []
    return best(candidates(vecs, queries, k, metric, split_col, digits), k, "query_id", *keys)


def candidates(vecs: DataFrame, queries: DataFrame, k: int, metric: str = "ip", split_col: str | None = None, digits: int = 6) -> DataFrame:
    """(query_id, [split], vec_id, score): each task's k best for each query."""
    keys = [split_col] if split_col else []
    kinds = {f.name: f.dataType.simpleString() for f in [*vecs.schema, *queries.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", *keys, "vec_id"]) + ", score double"

    def one(block: list) -> DataFrame:
        ids, q = np.array([r["query_id"] for r in block], np.int64), np.array([r["q"] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict = {}
            for batch in _parts(batches, len(ids)):
                s, names = _scores(q, matrix(batch.column("v")), metric, digits), np.asarray(batch.column("vec_id"))
                groups = np.asarray(batch.column(split_col)) if split_col else np.zeros(len(names), np.int64)
                for g in np.unique(groups):
                    inside = groups == g
                    met.setdefault(g, Best(len(ids), k)).meet(s[:, inside], names[inside])
            for g, found in met.items():
                n = [len(x) for x in found.ids]
                columns = [pa.array(np.repeat(ids, n)), *([pa.array(np.repeat(g, sum(n)))] if split_col else []), pa.array(np.concatenate(found.ids)), pa.array(np.concatenate(found.scores))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", *keys, "vec_id", "score"])

        return vecs.select(*keys, "vec_id", "v").where("v IS NOT NULL").mapInArrow(run, schema)

    return _passes(queries.select("query_id", "q").where("q IS NOT NULL"), one, "candidates")


def target_ranks(vecs: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, label, target_rank: the rank of the best other vector of the query's label among
    vecs(vec_id, v, label), for queries(query_id, q, label). Two passes a block: the target of each query,
    then how many rows are ahead of it; a task emits a row a query."""
    kind, arrow_kind = queries.schema["label"].dataType.simpleString(), to_arrow_type(queries.schema["label"].dataType)

    def one(block: list) -> DataFrame:
        ids, labels, q = np.array([r["query_id"] for r in block], np.int64), np.array([r["label"] for r in block]), np.array([r["q"] for r in block], np.float64)
        rows = vecs.select("vec_id", "v", "label").where("v IS NOT NULL")

        def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = Best(len(ids), 1)
            for batch in _parts(batches, len(ids)):
                names, s = np.asarray(batch.column("vec_id")), _scores(q, matrix(batch.column("v")), "ip", digits)
                own = (np.asarray(batch.column("label"))[None, :] == labels[:, None]) & (names[None, :] != ids[:, None])
                met.meet(s, names, own)
            n = [len(x) for x in met.ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *met.ids])), pa.array(np.concatenate([np.zeros(0), *met.scores]))], names=["query_id", "vec_id", "score"])

        found = {r["query_id"]: r for r in best(rows.mapInArrow(targets, "query_id long, vec_id long, score double"), 1, "query_id").collect()}
        have = np.array([int(i) in found for i in ids], bool)
        score, target = np.array([found[int(i)]["score"] for i in ids[have]]), np.array([found[int(i)]["vec_id"] for i in ids[have]], np.int64)

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(int(have.sum()), np.int64)
            for batch in _parts(batches, len(n)):
                s, names = _scores(q[have], matrix(batch.column("v")), "ip", digits), np.asarray(batch.column("vec_id"))
                n += ((s > score[:, None]) | ((s == score[:, None]) & (names[None, :] <= target[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[have]), pa.array(labels[have].tolist(), arrow_kind), pa.array(n)], names=["query_id", "label", "n"])

        return rows.mapInArrow(ahead, f"query_id long, label {kind}, n long").groupBy("query_id", "label").agg(F.sum("n").alias("target_rank"))

    return _passes(queries.select("query_id", "q", "label"), one, "ranks")


#: The bin of 2**-21.
_NEAR_ZERO = int(np.float64(2.0**-21).view(np.int64)) >> 47


def _bins(scores: np.ndarray) -> np.ndarray:
    """Numbers in the order of the scores, alike for scores that differ by a thirtieth or less. What rounds to zero at six
    digits is alike, so that the numbers between the least and the greatest score are few."""
    bits = (np.abs(scores).view(np.int64) >> 47) - _NEAR_ZERO
    return (np.where(scores < 0, -1, 1) * np.maximum(bits, 0)).astype(np.int32)


def _span(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of each bin."""
    size = np.abs(bins.astype(np.int64)) + _NEAR_ZERO
    near, far = (size << 47).view(np.float64), (((size + 1) << 47) - 1).view(np.float64)
    return np.where(bins > 0, near, -far), np.where(bins < 0, -near, far)


def _finite(s: np.ndarray) -> np.ndarray:
    """The scores with what is not finite put at the ends, no number above all, as a sort has it."""
    return s if np.isfinite(s).all() else np.nan_to_num(s, nan=np.finfo(np.float64).max)


def _split(batches: Iterator[pa.RecordBatch], n: int, keys: list[str]) -> Iterator[tuple]:
    """(split, batch): the batches in parts of at most CELLS scores with n queries, each of one split."""
    for batch in _parts(batches, n):
        groups = np.asarray(batch.column(keys[0])) if keys else np.zeros(batch.num_rows, np.int64)
        for g in np.unique(groups):
            yield g, batch.filter(pa.array(groups == g)) if keys else batch


class Counts:
    """How many scores of each query are in each bin."""

    def __init__(self, n: int):
        self.low, self.table = 0, np.zeros((n, 0), np.int32)  # a task's rows, fewer than 2**31

    def meet(self, bins: np.ndarray) -> None:
        low, high = int(bins.min()), int(bins.max()) + 1
        if not self.table.shape[1]:
            self.low = low
        before, after = max(0, self.low - low), max(0, high - self.low - self.table.shape[1])
        if before or after:
            self.table, self.low = np.pad(self.table, ((0, 0), (before, after))), self.low - before
        np.add.at(self.table.reshape(-1), (np.arange(len(bins))[:, None] * self.table.shape[1] + (bins - self.low)).ravel(), np.int32(1))


#: Places into which a range of scores or ids is divided, and rows of a query that are emitted rather than divided further.
PLACES, FEW = 64, 512
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Places:
    """How many values of each query are in each place of its range, and the first and last of them."""

    def __init__(self, n: int, kind: type):
        ends = (_MOST, _LEAST) if kind == np.int64 else (np.inf, -np.inf)
        self.n, self.first, self.last = np.zeros(n * PLACES, np.int64), np.full(n * PLACES, ends[0], kind), np.full(n * PLACES, ends[1], kind)

    def meet(self, at: np.ndarray, place: np.ndarray, values: np.ndarray) -> None:
        flat = at * PLACES + place
        self.n += np.bincount(flat, minlength=len(self.n))
        np.minimum.at(self.first, flat, values)
        np.maximum.at(self.last, flat, values)


class Ends:
    """Where each query's k best end. All rows before a range are among them, and the first `room` of the `inside` in it. The range
    goes from `first` to `last` by negated score and, where that is one score, from `low` to `high` by id."""

    def __init__(self, n: int):
        self.first, self.last, self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, _LEAST), np.full(n, _MOST)
        self.room, self.inside = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(self, at: int, first: float, last: float, room: int, inside: int, by_id: bool = False) -> None:
        self.room[at], self.inside[at] = room, inside
        if by_id:
            self.low[at], self.high[at] = first, last
            if inside <= room:  # all rows of the range are among the best, so they are before it
                self.low[at], self.high[at] = min(last, _MOST - 1) + 1, last
                self.first[at], self.last[at] = (self.first[at], -np.inf) if last < _MOST else (np.nextafter(self.last[at], np.inf), -np.inf)
        else:
            self.first[at], self.last[at] = (first, last) if inside > room else (np.nextafter(last, np.inf), -np.inf)

    def open(self, by_id: bool) -> np.ndarray:
        """The queries whose range is to be divided, by score or, where it is one score, by id."""
        return np.flatnonzero((self.inside > self.room) & (self.inside > FEW) & ((self.first == self.last) == by_id) & (self.low < self.high))

    def before(self, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = v < self.first[:, None]
        tied = np.flatnonzero(self.low > _LEAST)
        if len(tied):
            out[tied] |= (v[tied] == self.first[tied, None]) & (ids[None, :] < self.low[tied, None])
        return out

    def within(self, v: np.ndarray, ids: np.ndarray, queries: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Positions, among `queries` and the ids, of what is in the range."""
        at, row = np.nonzero((v >= self.first[queries, None]) & (v <= self.last[queries, None]))
        near = (ids[row] >= self.low[queries][at]) & (ids[row] <= self.high[queries][at])
        return at[near], row[near]


def _ends(rows: DataFrame, n: int, t: np.ndarray, k: int, metric: str, keys: list[str], kind: str) -> dict:
    """For each split of vecs(vec_id, theme) the `Ends` of the queries' k best themes. One pass counts scores by bin; further ones divide
    the bin in which the k-th lies, while it holds more than FEW rows and not all of them are among the k. A task emits a row a
    query and bin or place."""
    by = ", ".join(f"{c} {kind}" for c in keys) + ", " * len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict = {}
        for g, batch in _split(batches, n, keys):
            met.setdefault(g, Counts(n)).meet(_bins(_finite(_scores(t, matrix(batch.column("theme")), metric, 6))))
        for g, counts in met.items():
            step = max(1, CELLS // max(1, counts.table.shape[1]))
            for first in range(0, n, step):
                part = counts.table[first : first + step]
                at, bins = np.nonzero(part)
                columns = [*([pa.array(np.repeat(g, len(at)))] if keys else []), pa.array(at + first), pa.array(bins + counts.low), pa.array(part[at, bins].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "at", "bin", "n"])

    counted = rows.select(*keys, "theme").mapInArrow(count, f"{by}at long, bin long, n long")
    sums = counted.groupBy(*keys, "at", "bin").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(W.partitionBy(*keys, "at").orderBy(F.desc("bin")))
    last = sums.withColumn("up_to", up_to).where(F.col("up_to") - F.col("n") < k).groupBy(*keys, "at").agg(F.min("bin").alias("bin"), F.max("up_to").alias("up_to"), F.min_by("n", "bin").alias("n"))
    out: dict = {}
    for r in last.collect():  # a row a query of the block and split
        least, most = _span(np.array([r["bin"]]))
        out.setdefault(r[keys[0]] if keys else 0, Ends(n)).put(r["at"], -most[0], -least[0], k - r["up_to"] + r["n"], r["n"])
    for by_id in (False, True):
        while any(len(ends.open(by_id)) for ends in out.values()):
            found = _divided(rows, out, t, metric, keys, by, by_id)
            for ends in out.values():  # a range of which nothing is found, as products may differ in their last bit, is not divided again
                ends.inside[ends.open(by_id)] = 0
            for r in found:
                ends, at = out[r[keys[0]] if keys else 0], r["at"]
                ends.put(at, r["first"], r["last"], ends.room[at] - r["up_to"] + r["n"], r["n"], by_id)
    return out


def _divided(rows: DataFrame, ends: dict, t: np.ndarray, metric: str, keys: list[str], by: str, by_id: bool) -> list:
    """For each split and query whose range is open: the place of the range in which its best end, its first and last value, how many rows it
    has, and how many the range has up to it."""
    open_at = {g: e.open(by_id) for g, e in ends.items()}
    kind, kind_name = (np.int64, "long") if by_id else (np.float64, "double")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict = {}
        for g, batch in _split(batches, max(map(len, open_at.values())), keys):
            at, e, ids = open_at[g], ends[g], np.asarray(batch.column("vec_id"))
            if len(at):
                v = -_finite(_scores(t[at], matrix(batch.column("theme")), metric, 6))
                i, j = e.within(v, ids, at)
                if by_id:  # differences of 64 bits, whatever the signs
                    values, low = ids[j], e.low[at][i]
                    done, whole = (values.view(np.uint64) - low.view(np.uint64)).astype(np.float64), (e.high[at][i].view(np.uint64) - low.view(np.uint64)).astype(np.float64)
                else:
                    values, first = v[i, j], e.first[at][i]
                    done, whole = values - first, e.last[at][i] - first
                met.setdefault(g, Places(len(at), kind)).meet(i, (done / whole * (PLACES - 1)).astype(np.int64), values)
        for g, places in met.items():
            has = np.flatnonzero(places.n)
            at = open_at[g][has // PLACES]
            columns = [*([np.repeat(g, len(has))] if keys else []), at, has % PLACES, places.n[has], places.first[has], places.last[has], ends[g].room[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*keys, "at", "place", "n", "first", "last", "room"])

    counted = rows.select(*keys, "vec_id", "theme").mapInArrow(count, f"{by}at long, place long, n long, first {kind_name}, last {kind_name}, room long")
    sums = counted.groupBy(*keys, "at", "room", "place").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    up_to = F.sum("n").over(W.partitionBy(*keys, "at", "room").orderBy("place"))
    near = sums.withColumn("up_to", up_to).where(F.col("up_to") - F.col("n") < F.col("room"))
    return near.groupBy(*keys, "at", "room").agg(F.max("up_to").alias("up_to"), *[F.max_by(c, "place").alias(c) for c in ("n", "first", "last")]).collect()


def scoped_candidates(vecs: DataFrame, queries: DataFrame, theme_k: int, metric: str = "ip", split_col: str | None = None, dense_k: int | None = None) -> DataFrame:
    """(query_id, [split], vec_id, theme_score, score, room): rows that hold each query's `theme_k` best by theme, with both scores,
    of vecs(vec_id, v, theme) for queries(query_id, q, theme). Passes over the themes first find where these end (`_ends`), so the
    last one emits them, without room, and FEW more or ties, of which the `room` best by theme belong to them. Of more than FEW that are
    surely among them, a task keeps the `dense_k` best by vector where that is given."""
    keys = [split_col] if split_col else []
    kinds = {f.name: f.dataType.simpleString() for f in [*vecs.schema, *queries.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", *keys, "vec_id"]) + ", theme_score double, score double, room long"
    names = ["query_id", *keys, "vec_id", "theme_score", "score", "room"]
    choose = dense_k is not None and theme_k > FEW

    def one(block: list) -> DataFrame:
        ids, q, t = np.array([r["query_id"] for r in block], np.int64), np.array([r["q"] for r in block], np.float64), np.array([r["theme"] for r in block], np.float64)
        rows = vecs.select(*keys, "vec_id", "v", "theme").where("theme IS NOT NULL AND v IS NOT NULL")
        ends = _ends(rows, len(ids), t, theme_k, metric, keys, kinds.get(split_col, ""))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict = {}
            for g, batch in _split(batches, len(ids), keys):
                s, v, found, end = _scores(t, matrix(batch.column("theme")), metric, 6), matrix(batch.column("v")), np.asarray(batch.column("vec_id")), ends[g]
                order = -_finite(s)
                sure = end.before(order, found)
                if choose:
                    met.setdefault(g, Best(len(ids), dense_k)).meet(_scores(q, v, "ip", 6), found, sure, s)
                for (at, row), room in ((end.within(order, found), end.room), *([] if choose else [(np.nonzero(sure), None)])):
                    for part in range(0, len(at), 1 << 14):
                        i, j = at[part : part + (1 << 14)], row[part : part + (1 << 14)]
                        dense = np.round(np.einsum("ij,ij->i", v[j], q[i]), 6)
                        columns = [ids[i], *([np.repeat(g, len(i))] if keys else []), found[j], s[i, j], dense]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(i), pa.int64()) if room is None else pa.array(room[i])], names=names)
            for g, kept in met.items():
                n = [len(x) for x in kept.ids]
                columns = [np.repeat(ids, n), *([np.repeat(g, sum(n))] if keys else []), np.concatenate(kept.ids), np.concatenate(kept.also), np.concatenate(kept.scores)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(sum(n), pa.int64())], names=names)

        return rows.mapInArrow(emit, schema)

    return _passes(queries.select("query_id", "q", "theme"), one, "scoped")


def blended(vecs: DataFrame, queries: DataFrame, k: int, dense_weight: float, metric: str = "ip", split_col: str | None = None) -> DataFrame:
    """(query_id, [split], vec_id, score): each task's k best for each query by both scores, of all vecs(vec_id, v, theme) that have both,
    for queries(query_id, q, theme)."""
    keys = [split_col] if split_col else []
    kinds = {f.name: f.dataType.simpleString() for f in [*vecs.schema, *queries.schema]}
    schema, theme_weight = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", *keys, "vec_id"]) + ", score double", round(1 - dense_weight, 9)

    def one(block: list) -> DataFrame:
        ids, q, t = np.array([r["query_id"] for r in block], np.int64), np.array([r["q"] for r in block], np.float64), np.array([r["theme"] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict = {}
            for g, batch in _split(batches, len(ids), keys):
                s = dense_weight * _scores(q, matrix(batch.column("v")), "ip", 6) + theme_weight * _scores(t, matrix(batch.column("theme")), metric, 6)
                met.setdefault(g, Best(len(ids), k)).meet(np.round(s, 8) + 0.0, np.asarray(batch.column("vec_id")))
            for g, found in met.items():
                n = [len(x) for x in found.ids]
                columns = [np.repeat(ids, n), *([np.repeat(g, sum(n))] if keys else []), np.concatenate(found.ids), np.concatenate(found.scores)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", *keys, "vec_id", "score"])

        return vecs.select(*keys, "vec_id", "v", "theme").where("theme IS NOT NULL AND v IS NOT NULL").mapInArrow(run, schema)

    return _passes(queries.select("query_id", "q", "theme"), one, "blended")


def theme_scoped(vecs: DataFrame, queries: DataFrame, theme_k: int | None, dense_k: int | None, k: int, dense_weight: float, metric: str = "ip", eps: float = 1e-8, split_col: str | None = None) -> DataFrame:
    """Two-stage retrieval: vecs(vec_id, v, theme), queries(query_id, q, theme). The theme_k best by
    theme are scored by vector, the dense_k best of these blended, and the k best returned; with neither (both None) all
    rows are blended. Queries whose theme is null or has no length fall back to dense retrieval alone; those without a
    vector have no result, and rows without a vector or theme are not retrieved by theme."""
    if (theme_k is None) != (dense_k is None):
        raise ValueError("theme_k and dense_k are given both or not at all")
    keys = ["query_id", *([split_col] if split_col else [])]
    has_theme = F.coalesce(vectors.norm(F.col("theme")) >= eps, F.lit(False))
    asked = queries.where("q IS NOT NULL")
    if theme_k is None:
        scored = blended(vecs, asked.where(has_theme), k, dense_weight, metric, split_col)
    else:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.isnull("room"), F.desc("theme_score"), "vec_id"))
        found = scoped_candidates(vecs, asked.where(has_theme), theme_k, metric, split_col, dense_k)
        stage = found.withColumn("place", place).where("room IS NULL OR place <= room").drop("place", "room")
        dense = best(stage, dense_k, *keys).drop("rank").withColumnRenamed("score", "dense_score")
        scored = dense.withColumn("score", F.round(dense_weight * F.col("dense_score") + F.round(F.lit(1 - dense_weight), 9) * F.col("theme_score"), 8))
    scoped = best(scored, k, *keys).select(*keys, "vec_id", "score", "rank")
    return scoped.unionByName(topk(vecs, asked.where(~has_theme), k, "ip", split_col).select(*keys, "vec_id", "score", "rank"))


def centroids(vecs: DataFrame, label: str = "label") -> DataFrame:
    """label, position, value: the mean vector of each label, rounded so that no order of sums shows."""
    return vecs.select(label, F.posexplode("v").alias("position", "x")).groupBy(label, "position").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def with_theme(vecs: DataFrame, label: str = "label") -> DataFrame:
    """`vecs` with `theme`: its product with each label's centroid, in label order, at least 1e-15. The
    centroids travel with the function, so more than MOST_LABELS of them are an error."""
    if vecs.select(label).distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"themes of more than {MOST_LABELS} labels")
    c = centroids(vecs, label).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("c"))
    rows = np.array([r["c"] for r in c.orderBy(label).collect()], np.float64)

    def run(v: pa.Array) -> pa.Array:
        values = np.round(np.maximum(matrix(v) @ rows.T, 1e-15), 6) if len(rows) and len(v) else np.zeros((len(v), len(rows)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(rows), pa.int32()), pa.array(values.ravel()))

    return vecs.withColumn("theme", F.arrow_udf(run, T.ArrayType(T.DoubleType()))("v"))
