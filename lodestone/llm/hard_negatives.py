"""Hard-negative mining with Kronecker-packed products.

Components are floored to integers. Several candidates' components, biased so that none is negative, lie in
separated fields of one wide integer; one multiplication by an anchor's component serves all of them, and
the sums over the components are unpacked to exact scores. The wide integers are those of up to 53 bits that
doubles hold exactly, so the products of a block of anchors and a chunk of candidates are one matrix product. Field
widths follow from the largest components met; scores beyond 53 bits take 64-bit integers of one field, and
those beyond MOST_BITS are an error.

Anchors are a stated set of rows. They go in blocks of a bounded size, each block against all rows in two passes:
its positives first, then the negatives whose score is within each positive's limits. A task keeps the first
rows of each anchor and positive, so what is shuffled is some rows an anchor, positive and task.

Defined cases: a row without id, label or vector, or with a null or non-finite component, takes no part; rows meet
rows of their own vector length only; repeated rows are rows of their own as candidates and one as an anchor; a
row with the anchor's id is not its positive; ties go to the smaller id; an anchor without positives, and a
positive without negatives, give no row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import retrieval as rt

#: Bits that doubles hold exactly, and bits of a score at most: its hundredfold still fits 64.
EXACT_BITS, MOST_BITS = 53, 55
#: Candidates that meet a block of anchors at once.
CHUNK = 1024


def _width(anchors: np.ndarray, candidates: np.ndarray) -> int:
    """Bits of a field: a sign and the largest sum of products with biased components."""
    most = int(np.abs(candidates).max(initial=0))
    return (int(np.abs(anchors).sum(1).max(initial=0)) * 2 * most).bit_length() + 1


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The inner products of whole-numbered vectors, as 64-bit integers."""
    width, n = _width(anchors, candidates), len(candidates)
    if width > MOST_BITS:
        raise ValueError(f"scores of {width} bits; {MOST_BITS} are possible")
    if width > EXACT_BITS:
        return anchors.astype(np.int64) @ candidates.astype(np.int64).T
    fields = EXACT_BITS // width
    columns = -(-n // fields)
    bias = np.abs(candidates).max(initial=0)
    padded = np.zeros((fields * columns, candidates.shape[1]))
    padded[:n] = candidates + bias
    # Field j of a packed row holds candidate j * columns + its number.
    packed = sum(padded[j * columns : (j + 1) * columns] * 2.0 ** (width * j) for j in range(fields))
    half = 1 << (width - 1)
    sums = (anchors @ packed.T).astype(np.int64) + sum(half << (width * j) for j in range(fields))
    unpacked = np.concatenate([((sums >> (width * j)) & ((1 << width) - 1)) for j in range(fields)], 1)[:, :n]
    return unpacked - half - (bias * anchors.sum(1)).astype(np.int64)[:, None]


class First:
    """Of what each slot meets between its limits, the first k by score, then smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.high, self.k = high, k
        # A slot that is full wants what comes before its last: a score above `edge`, or that with a smaller id.
        self.edge, self.edge_id = low - 1, np.full(len(low), np.iinfo(np.int64).min)
        self.slots, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, s: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        edge = self.edge[:, None]
        slot, at = np.nonzero(allowed & (s <= self.high[:, None]) & ((s > edge) | ((s == edge) & (ids[None, :] < self.edge_id[:, None]))))
        if not len(slot):
            return
        slots, found, names = np.append(self.slots, slot), np.append(self.scores, s[slot, at]), np.append(self.ids, ids[at])
        order = np.lexsort((names, -found, slots))
        slots, found, names = slots[order], found[order], names[order]
        nth = np.arange(len(slots)) - np.searchsorted(slots, slots)
        last = nth == self.k - 1
        self.edge[slots[last]], self.edge_id[slots[last]] = found[last], names[last]
        kept = nth < self.k
        self.slots, self.scores, self.ids = slots[kept], found[kept], names[kept]


def _whole(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floored vectors of each length in a column of vectors."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        yield at, np.floor(scale * np.asarray(flat, np.float64).reshape(len(at), size))


def _chunks(n: int) -> Iterator[slice]:
    """As many rows as before, up to CHUNK: few of a chunk then come before what a slot holds."""
    start, step = 0, 64
    while start < n:
        yield slice(start, start + step)
        start, step = start + step, min(2 * step, CHUNK)


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: Column | str = "label",
         scale: float = 256.0, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row where `anchors`
    holds, and each of its best `n_positives` other rows of its label, the best `n_negatives` rows of other labels
    whose score is from `low` to `high` per cent of the positive's. Ids and labels are whole numbers."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    whole = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN sorts above infinity
    marked = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), anchors.alias("anchor"))
    marked = marked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    rows = marked.select("id", "label", "v")
    asked = marked.where("anchor").select(F.col("id").alias("query_id"), "label", "v").distinct()

    def one(block: list) -> DataFrame:
        ids, labels = (np.array([r[c] for r in block], np.int64) for c in ("query_id", "label"))
        sizes = np.array([len(r["v"]) for r in block], np.int64)
        own = {int(d): (at := np.flatnonzero(sizes == d), np.floor(scale * np.array([block[i]["v"] for i in at], np.float64).reshape(len(at), d))) for d in np.unique(sizes)}

        def pass_over(batches: Iterator[pa.RecordBatch], firsts: dict[int, list[First]], same: bool) -> None:
            for batch in batches:
                names, kinds = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
                for at, vectors in _whole(batch.column("v"), scale):
                    if vectors.shape[1] not in own:
                        continue
                    slots, mine_ = own[vectors.shape[1]]
                    for part in _chunks(len(at)):
                        name, s = names[at[part]], scores(mine_, vectors[part])
                        equal = kinds[at[part]][None, :] == labels[slots][:, None]
                        allowed = equal & (name[None, :] != ids[slots][:, None]) if same else ~equal
                        for first in firsts[vectors.shape[1]]:
                            first.meet(s, name, allowed)

        def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edge = 1 << 62
            firsts = {d: [First(np.full(len(slots), -edge), np.full(len(slots), edge), n_positives)] for d, (slots, _) in own.items()}
            pass_over(batches, firsts, True)
            for d, (first,) in firsts.items():
                yield pa.RecordBatch.from_arrays([pa.array(own[d][0][first.slots]), pa.array(first.ids), pa.array(first.scores)], names=["slot", "id", "score"])

        best = W.partitionBy("slot").orderBy(F.desc("score"), "id")
        found = rows.mapInArrow(positives, "slot long, id long, score long").withColumn("nth", F.row_number().over(best) - 1).where(F.col("nth") < n_positives)
        # At most n_positives rows an anchor of the block.
        table = {(r["slot"], r["nth"]): (r["id"], r["score"]) for r in found.collect()}

        def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limits = {}
            for d, (slots, _) in own.items():
                limits[d] = []
                for nth in range(n_positives):
                    known = [table.get((int(i), nth)) for i in slots]
                    least = np.array([1 if x is None else -(-low * x[1] // 100) for x in known], np.int64)
                    most = np.array([0 if x is None else high * x[1] // 100 for x in known], np.int64)
                    limits[d].append(First(least, most, n_negatives))
            pass_over(batches, limits, False)
            for d, firsts in limits.items():
                for nth, first in enumerate(firsts):
                    slot = own[d][0][first.slots]
                    positive = [table[int(i), nth] for i in slot]
                    columns = [slot, np.full(len(slot), nth), ids[slot], [p[0] for p in positive], first.ids, [p[1] for p in positive], first.scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "nth", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        order = W.partitionBy("slot", "nth").orderBy(F.desc("negative_score"), "negative_id")
        met = rows.mapInArrow(negatives, "slot long, nth long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).drop("slot", "nth")

    return rt._passes(asked, one, "negatives").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_dot_product(a.v, v.v)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND len(a.v) = len(v.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
