"""The boundary to models: a callable from texts to texts, run batch by batch on the executors.

The engine trains and loads no model. A hook gets a list of texts and returns one result for each; a
batch that fails is tried again and then gets the fallback value. `stub_*` are deterministic stand-ins.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tried(hook: Callable[[list[str]], list[str]], texts: list[str], tries: int, wait_s: float) -> list[str] | None:
    """What the hook returns for the texts; None if it fails `tries` times or returns another number of results."""
    for attempt in range(tries):
        try:
            result = list(hook(texts))
            if len(result) == len(texts):
                return result
        except Exception:
            pass
        if attempt + 1 < tries:
            time.sleep(wait_s * 2**attempt)
    return None


def generate(df: DataFrame, prompt: str, hook: Callable[[list[str]], list[str]], out: str = "output", tries: int = 3, wait_s: float = 0.0, fallback: str | None = None) -> DataFrame:
    """`df` with the hook's text for each prompt. A batch that fails `tries` times is asked text by text, each as often, so
    one bad prompt costs the fallback for itself alone, whatever it shares a batch with. A null prompt is empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = [t or "" for t in column]
            result = _tried(hook, texts, tries, wait_s) if texts else []
            if result is None:
                result = [one[0] if (one := _tried(hook, [t], tries, wait_s)) else fallback for t in texts]
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(prompt)))


def encode(df: DataFrame, text: str, hook: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """`df` with the hook's vector for each text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in hook([t or "" for t in texts])])

    return df.withColumn(out, run(F.col(text)))


def stub_answer(texts: list[str]) -> list[str]:
    """The first sentence of the prompt's last line."""
    return [t.rsplit("\n", 1)[-1].split(". ")[0] for t in texts]


def stub_triples(texts: list[str]) -> list[str]:
    """One triple: first word, 'mentions', last word."""
    words = [t.split() or [""] for t in texts]
    return [f"(S> {w[0]}| P> mentions| O> {w[-1]})" for w in words]


def stub_vector(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of hashed character counts."""
    def hook(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for c in t:
                v[ord(c) % dim] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return hook


def similarity_label(score: Column, threshold: float = 0.8) -> Column:
    return F.when(score < threshold, "[SUBQ=YES]").otherwise("[SUBQ=NO] No subquery is needed.")
