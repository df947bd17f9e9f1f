"""ROUGE F-measures, as Arrow-batched functions.

Words are runs of a-z and 0-9 in lower case; with stemming, those of more than three letters are stemmed, each
distinct word of a batch once. Common subsequences are found on rows of bits, one integer a word, of which every
k-th is kept and the rest computed again: two texts of n words take about n^1.5 bits of memory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.stemming import stem

_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
KINDS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def words(text: str, stems: dict[str, str] | None = None) -> list[str]:
    """The words of a text, as `stems` has them."""
    found = _WORD.findall(text.lower())
    return found if stems is None else [stems[w] for w in found]


def common(a: list[str], b: list[str]) -> list[int]:
    """Positions of `a` in one longest common subsequence with `b`, ascending: from the ends, equal words pair up,
    and else the last word of `b` goes where that alone keeps the length, the last of `a` otherwise."""
    masks: dict[str, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full, every = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    def below(row: int, w: str) -> int:
        """The next row: bit j is 0 where the length grows from the first j to the first j + 1 words of `b`."""
        u = row & masks.get(w, 0)
        return (row + u | row - u) & full

    kept, row = [], full
    for i, w in enumerate(a):
        if i % every == 0:
            kept.append(row)
        row = below(row, w)
    out, rows, j = [], [], len(b)
    for i in range(len(a), 0, -1):
        if (i - 1) % every == every - 1 or i == len(a):  # rows i0 .. i0 + every of the block before row i
            rows = [kept[(i - 1) // every]]
            for w in a[(i - 1) // every * every : i]:
                rows.append(below(rows[-1], w))
        here, above = rows[i - (i - 1) // every * every], rows[i - 1 - (i - 1) // every * every]
        length = lambda r: j - (r & (1 << j) - 1).bit_count()  # noqa: B023, E731
        known = length(above)
        while j and a[i - 1] != b[j - 1] and length(here) - (~here >> j - 1 & 1) > known:
            j -= 1
            known = length(above)
        if j and a[i - 1] == b[j - 1]:
            out.append(i - 1)
            j -= 1
    return out[::-1]


def _f(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if hits else 0.0


def _lsum(p: list[list[str]], g: list[list[str]]) -> float:
    """Union of the common subsequences of each gold sentence with all predicted ones."""
    left, hits = Counter(w for s in p for w in s), 0
    for s in g:
        for i in sorted(set().union(*[common(s, x) for x in p])):
            if left[s[i]] > 0:
                left[s[i]] -= 1
                hits += 1
    return _f(hits, sum(map(len, p)), sum(map(len, g)))


def scores(prediction: str | None, gold: str | None, kinds: tuple[str, ...] = KINDS, stems: dict[str, str] | None = None) -> dict[str, float]:
    """The F-measure of each kind; a null text is empty, and scores 0."""
    sentences = [[w for s in _SENTENCE.split(t or "") if (w := words(s, stems))] for t in (prediction, gold)]
    p, g = ([w for s in x for w in s] for x in sentences)
    out = {}
    for kind in kinds:
        if kind == "rougeLsum":
            out[kind] = _lsum(*sentences)
        elif kind == "rougeL":
            out[kind] = _f(len(common(g, p)), len(p), len(g))
        else:
            n = int(kind.removeprefix("rouge"))
            a, b = (Counter(zip(*[x[k:] for k in range(n)])) for x in (p, g))
            out[kind] = _f((a & b).total(), a.total(), b.total())
    return out


def lsum(prediction: str, gold: str) -> float:
    return scores(prediction, gold, ("rougeLsum",))["rougeLsum"]


def rouge(prediction: Column, golds: Column, kinds: tuple[str, ...] = KINDS, stemmed: bool = True) -> Column:
    """struct of the kinds' F-measures against the gold text with the greatest of the last kind, of equals the
    last; without gold texts all are 0. `golds` is an array of texts."""
    kind = T.StructType([T.StructField(k, T.DoubleType()) for k in kinds])

    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        predictions, references = p.to_pylist(), g.to_pylist()
        stems = None
        if stemmed:
            seen = {w for t in [*predictions, *[x for r in references for x in r or []]] for w in words(t or "")}
            stems = {w: stem(w) if len(w) > 3 else w for w in seen}
        out = []
        for text, several in zip(predictions, references):
            best = dict.fromkeys(kinds, 0.0)
            for gold in several or []:
                new = scores(text, gold, kinds, stems)
                best = new if new[kinds[-1]] >= best[kinds[-1]] else best
            out.append(best)
        return pa.array(out, pa.struct([(k, pa.float64()) for k in kinds]))

    return F.arrow_udf(run, kind)(prediction, golds)


def rouge_lsum(prediction: Column, gold: Column, stemmed: bool = False) -> Column:
    return rouge(prediction, F.array(gold), ("rougeLsum",), stemmed)["rougeLsum"]
