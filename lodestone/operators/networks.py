"""Forward passes of layered perceptrons over vectors, and the themes of texts by them.

Weights are a small model: they travel with the function (Spark broadcasts it once an executor) and are checked
against MOST_WEIGHTS. A batch of vectors goes through each layer as one matrix product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vectors as vx

#: Numbers that a model's layers may hold together: 512 MB of doubles.
MOST_WEIGHTS = 1 << 26


def _softmax(x: np.ndarray) -> np.ndarray:
    powers = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
    return powers / powers.sum(1, keepdims=True)


ACTIVATIONS = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0.0), "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)), "softmax": _softmax}


@dataclass(frozen=True)
class Layer:
    """weight is one row an output; the activation is one of ACTIVATIONS."""

    weight: np.ndarray
    bias: np.ndarray
    activation: str = "none"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ACTIVATIONS[self.activation](x @ self.weight.T + self.bias)


def checked(layers: Sequence[Layer]) -> list[Layer]:
    """The layers, if they fit each other and the bound."""
    size = sum(x.weight.size + x.bias.size for x in layers)
    if size > MOST_WEIGHTS:
        raise ValueError(f"a model of {size} weights; {MOST_WEIGHTS} are possible")
    for k, x in enumerate(layers):
        if x.weight.shape[0] != x.bias.size or k and x.weight.shape[1] != layers[k - 1].weight.shape[0] or x.activation not in ACTIVATIONS:
            raise ValueError(f"layer {k} does not fit")
    return list(layers)


def forward(v: Column, layers: Sequence[Layer]) -> Column:
    """What the layers make of each vector, as doubles; null for a null vector. A vector of another length or with
    null components is an error."""
    layers = checked(layers)
    size = layers[0].weight.shape[1]

    def run(column: pa.Array) -> pa.Array:
        there = np.asarray(column.is_valid())
        some = column.filter(pa.array(there))
        flat = some.flatten().cast(pa.float64())
        if flat.null_count or len(flat) != size * len(some) or len(some) and set(np.unique(np.asarray(some.value_lengths()))) != {size}:
            raise ValueError(f"vectors of {size} numbers are wanted")
        x = np.asarray(flat, np.float64).reshape(len(some), size)
        for layer in layers:
            x = layer(x)
        offsets = np.concatenate([[0], np.cumsum(there)]) * layers[-1].bias.size
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel()), mask=pa.array(~there))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(v)


def positive_labels(p: Column, names: Sequence[str], threshold: float = 0.5) -> Column:
    """The names whose probability is over the threshold, in their order."""
    kept = F.filter(F.arrays_zip(p.alias("p"), F.array(*map(F.lit, names)).alias("name")), lambda x: x["p"] > threshold)
    return F.transform(kept, lambda x: x["name"])


def themes(df: DataFrame, vector: str, classifier: Sequence[Layer], shifter: Sequence[Layer], mode: Column, names: Sequence[str], k: int = 10, digits: int = 9) -> DataFrame:
    """`df` with `theme` (a distribution over `names`), `labels` (names that the classifier holds for likely) and `top` (the
    k best names with their values). Where `mode` is 'q' the classifier's distribution is shifted towards those of
    documents, in any other it stays. Values are rounded, so that no order of sums shows; only 'q' rows pay
    for the shift."""
    probabilities = df.withColumn("_p", F.transform(forward(F.col(vector), classifier), lambda x: F.round(x, digits)))
    asked = probabilities.withColumn("_asked", F.when(mode == "q", F.col("_p")))
    shifted = asked.withColumn("_shifted", F.transform(forward(F.col("_asked"), shifter), lambda x: F.round(x, digits)))
    named = F.array(*map(F.lit, names))
    out = shifted.withColumn("theme", F.coalesce("_shifted", "_p")).withColumn("labels", positive_labels(F.col("_p"), names))
    top = F.transform(vx.top_positions(F.col("theme"), k), lambda x: F.struct(F.get(named, x["i"]).alias("name"), x["p"].alias("p")))
    return out.withColumn("top", top).drop("_p", "_asked", "_shifted")
