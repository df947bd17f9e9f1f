"""Message passing over graphs of any size: rounds of weighted sums over incoming edges.

Nodes are numbered and edges are kept as short lists, a source with the numbers of its destinations, so a round moves a
row a list and not one an edge. It joins the lists with their sources' vectors and sums by destination: tasks add up what
they send by batches of edges, so a hub as destination sends a number a batch; a hub as source has many lists and is joined by
broadcast (`operators/skew.py`). Each round's vectors are written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators import skew
from lodestone.operators.networks import Layer, forward
from lodestone.tables import materialize


def _sums(sent: DataFrame, dim: int) -> DataFrame:
    """_id, _total (of the weights _w) and _sum, of the vectors _0, _1, ... sent to it."""
    parts = [F.sum(f"_{i}") for i in range(dim)]
    return sent.groupBy(F.col("dst").alias("_id")).agg(F.sum("_w").alias("_total"), F.array(*parts).alias("_sum"))


#: Edges that a task adds up at once, those of a task where there are more than the cores take at once, and the most of a list.
BATCH, TASK, LIST = 2**20, 2**21, 128


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _by_batch(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns of the parts, joined until they hold BATCH values."""
    held, n = [], 0
    for part in parts:
        held, n = [*held, part], n + len(part[0])
        if n >= BATCH:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _added(dst: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The destinations, each once and in order, with the sums of their values."""
    order = np.argsort(dst, kind="stable")
    dst = dst[order]
    at = _starts(dst)
    return [dst[at], *[np.add.reduceat(v[order], at) for v in values]] if len(dst) else [dst, *values]


def _list_array(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)).astype(np.int32)), pa.array(values))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as lists; a source may have several."""
    for src, dst in _by_batch([x.to_numpy() for x in b.columns] for b in batches):
        order = np.argsort(src, kind="stable")
        src = src[order]
        at = np.union1d(_starts(src), np.arange(0, len(src), LIST))
        yield pa.RecordBatch.from_arrays([pa.array(src[at]), _list_array(at, dst[order])], ["src", "to"])


def _lists(edges: DataFrame, hubs: DataFrame, n: int) -> DataFrame:
    """src and to, the destinations of some of its edges, at most LIST; dealt by source into n tasks, a hub's edges to all."""
    hub = F.broadcast(hubs.withColumn("_hub", F.lit(True)))
    part = F.when(F.col("_hub"), F.monotonically_increasing_id() % skew.HOT).otherwise(0)
    parts = edges.join(hub, "src", "left").select("src", "dst", part.alias("_part"))
    return parts.repartition(n, "src", "_part").select("src", "dst").mapInArrow(_pack, "src long, to array<long>")


def _sender(dim: int, blocks: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unfolded(b):
            to, *values = b.columns
            sizes = to.value_lengths().to_numpy(zero_copy_only=False)
            return [to.flatten().to_numpy(), *[np.repeat(v.to_numpy(zero_copy_only=False), sizes) for v in values]]

        for part in _by_batch(map(unfolded, batches)):
            dst, *sums = _added(*part)
            block = dst % blocks
            order = np.argsort(block, kind="stable")
            at = _starts(block[order])
            yield pa.RecordBatch.from_arrays([pa.array(block[order][at]), *[_list_array(at, x[order]) for x in (dst, *sums)]], ["_block", "_id", *[f"_{i}" for i in range(dim)]])

    return send


def _adder(dim: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for part in _by_batch([x.flatten().to_numpy() for x in b.columns[1:]] for b in batches):
            known = _added(*(part if known is None else [np.concatenate(x) for x in zip(known, part)]))
        if known is not None:
            ids, rows = known[0], np.stack(known[1:], 1)
            for k in range(0, len(ids), 10_000):
                some = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 10_000]), _list_array(np.arange(len(some)) * dim, some.ravel())], ["_id", "_sum"])

    return add


def _sums_of_lists(sent: DataFrame, dim: int, n: int) -> DataFrame:
    """_id and _sum, of the vectors _0, _1, ... sent to the nodes of the list `to`. Tasks send a row a batch and block of nodes."""
    names = [f"_{i}" for i in range(dim)]
    if not dim:
        return sent.sparkSession.createDataFrame([], "_id long, _sum array<double>")
    values = [F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in names]
    parts = sent.select("to", *values).mapInArrow(_sender(dim, 4 * n), f"_block long, _id array<long>, {', '.join(f'{x} array<double>' for x in names)}")
    return parts.repartition(n, "_block").mapInArrow(_adder(dim), "_id long, _sum array<double>")


def _blend(a: Column, x: Column, b: Column, y: Column, digits: int) -> Column:
    """a x + b y, rounded; a null x counts as zeros."""
    return F.when(x.isNull(), F.transform(y, lambda v: F.round(b * v, digits))).otherwise(F.zip_with(x, y, lambda u, v: F.round(a * u + b * v, digits)))


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int, how: str = "gcn", layers: Sequence[Layer] | None = None, temperature: float = 1.0, digits: int = 9, both: bool = False) -> DataFrame:
    """node, h of nodes(node, h) after `rounds` rounds over edges(src, dst), or over them and their inverses if `both`.

    'gcn': h becomes the sum over the node itself and its sources of their h, each divided by the root of both
    ends' degrees (incoming edges and itself). 'attention': the mean of the same, weighted by a softmax over a
    destination's edges of the cosine of both ends' vectors by `temperature`; a cosine is bounded, so no maximum
    is needed first. With `layers`, one a round, vectors go through the round's layer before they are passed on.

    Repeated edges count each time; edges with an end that is no node or null are left out; nodes without
    edges keep to themselves; `node` is unique and all vectors have one length; a null in a vector adds nothing to others. Values are rounded to `digits` a round,
    so that no order of sums shows."""
    first = nodes.select(F.size("h").alias("n")).first()
    dim = first["n"] if first else 0
    state = materialize(nodes.select("node", F.transform("h", lambda x: x.cast("double")).alias("h"), F.monotonically_increasing_id().alias("_id")), "nodes")
    number = lambda end: state.select(F.col("node").alias(end), F.col("_id").alias(f"_{end}"))
    known = edges.select("src", "dst").join(number("src"), "src").join(number("dst"), "dst")
    known = materialize(known.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")), "edges")
    if both:
        known = known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    total = known.count()
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    n = cores * max(1, -(-total // (cores * TASK)))
    degrees = materialize(known.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")), "degrees")
    targets = materialize(skew.hot_of(degrees, "dst", total), "hot_dst")
    sources = targets.withColumnRenamed("dst", "src") if both else materialize(skew.hot_keys(known, "src", total), "hot_src")
    lists = materialize(_lists(known, sources, n), "lists")
    state = state.join(degrees.withColumnRenamed("dst", "_id"), "_id", "left").select("_id", "node", "h", (1.0 / F.sqrt(1.0 + F.coalesce("_n", F.lit(0)))).alias("scale"))
    for k in range(rounds):
        if layers is not None:
            state, dim = state.withColumn("h", forward(F.col("h"), layers[k : k + 1])), layers[k].bias.size
        state = materialize(state, "round")
        flat = lambda weight: [(F.col(weight) * F.col("h")[i]).alias(f"_{i}") for i in range(dim)]
        own, own_weight = F.col("h"), F.col("scale")
        if how == "attention":
            near = lambda cosine: F.exp(F.coalesce(F.round(cosine, digits), F.lit(0.0)) / temperature)
            sent = skew.join_hot(lists, state.select(F.col("_id").alias("src"), "h"), "src", sources).select(F.explode("to").alias("dst"), "h")
            sent = skew.join_hot(sent, state.select(F.col("_id").alias("dst"), F.col("h").alias("_to")), "dst", targets)
            sent, own_weight = sent.withColumn("_w", near(vx.cosine(F.col("_to"), F.col("h")))), near(vx.cosine(own, own))
            sums = _sums(sent.select("dst", "_w", *flat("_w")), dim)
        else:
            sent = skew.join_hot(lists, state.select(F.col("_id").alias("src"), *flat("scale")), "src", sources)
            sums = _sums_of_lists(sent, dim, n)
        met = state.join(sums, "_id", "left")
        if how == "attention":
            whole = own_weight + F.coalesce("_total", F.lit(0.0))
            h = _blend(1 / whole, F.col("_sum"), own_weight / whole, own, digits)
        else:
            h = _blend(own_weight, F.col("_sum"), own_weight * own_weight, own, digits)
        state = met.select("_id", "node", h.alias("h"), "scale")
    return materialize(state.select("node", "h"), "round")
