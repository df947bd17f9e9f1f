"""Vector and distribution functions over ARRAY<FLOAT|DOUBLE> columns, computed in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with(scalar: Column, v: Column, f) -> Column:
    """f(x, scalar) of each entry, with the scalar computed once a row: an expression inside the inner function
    would be computed for every entry."""
    return F.flatten(F.transform(F.array(F.struct(scalar.alias("s"), v.alias("v"))), lambda b: F.transform(b["v"], lambda x: f(x, b["s"]))))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    return _with(norm(v), v, lambda x, n: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distribution(v: Column, eps: float = 1e-15) -> Column:
    """Clipped to [eps, 1] and scaled to sum 1."""
    clipped = F.transform(v, lambda x: F.least(F.greatest(x.cast("double"), F.lit(eps)), F.lit(1.0)))
    return _with(total(clipped), clipped, lambda x, n: x / n)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (square root, natural logarithm); rounding below zero counts as zero."""
    half = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    kl = lambda a: total(F.zip_with(a, half, lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)))
    return F.sqrt(F.greatest((kl(p) + kl(q)) / 2, F.lit(0.0)))


def wasserstein_values(p: Column, q: Column) -> Column:
    """Between the two sets of values, not of positions: mean distance of the sorted values."""
    return total(F.zip_with(F.array_sort(p), F.array_sort(q), lambda x, y: F.abs(x - y))) / F.size(p)


def l1(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def softmax(v: Column) -> Column:
    powers = _with(F.array_max(v).cast("double"), v, lambda x, most: F.exp(x.cast("double") - most))
    return F.flatten(F.transform(F.array(powers), lambda p: _with(total(p), p, lambda x, n: x / n)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def theme_of(v: Column, mode: Column, shift: Callable[[Column], Column]) -> Column:
    """A question's distribution (mode 'q') shifted towards those of documents; a document's as it is."""
    return F.when(mode == "q", shift(v)).otherwise(v)


def top_positions(v: Column, k: int) -> Column:
    """The k largest entries as structs (p, i), ties to the smaller position."""
    pairs = F.transform(v, lambda x, i: F.struct((-x.cast("double")).alias("n"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["n"]).alias("p"), s["i"].alias("i")))
