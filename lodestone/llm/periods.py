"""Periodic runs of words: difference-cover longest common extensions on a harmonic grid.

A run is a stretch of words with smallest period q, at least `min_length` and 2 q words long, that no
neighbouring word extends. A run of period p that is 2 p words long holds two neighbours of the grid 0, p, 2 p, ..
of its text, so each pair of neighbours with equal words is extended to both sides by longest common extensions;
where the sides add up to p words or more there is a run. All periods of a text of n words make about n ln n
pairs. A stretch that several periods give counts for the smallest.

An extension compares few words until both positions are of the difference cover (fixed offsets modulo its
period, so that any two positions reach it together within it). From there the suffixes that start in
the cover, alone sorted, give it as the least of a range of their neighbours' common prefixes, by a sparse table.
The other side is the same over reversed words. Suffixes are sorted for those texts only where a comparison
reaches the cover.

Texts go in blocks of about BLOCK_WORDS words, whose arrays are handled together; a longer text is a block of its own,
with memory in proportion to its words times the logarithm of their number.

Defined cases: words are what lies between ASCII white space; a null or empty text has no words, no runs and
collapses to the empty text; ids, repeated rows and other columns pass through untouched; an empty table
gives an empty result. The result columns `runs` and `collapsed` replace columns of the same names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import bind
from lodestone.llm.memory import trim

#: A perfect difference cover, whose differences are all residues.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_WORDS = 1 << 17
#: Grid pairs that are compared at once.
PAIRS = 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

_IN = np.isin(np.arange(PERIOD), COVER)
#: How far two positions of these residues are from the cover.
_SHIFT = np.array([[next(t for t in range(PERIOD) if _IN[(a + t) % PERIOD] and _IN[(b + t) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _same(w: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, `most` at most."""
    out, at, t = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
    while len(at):
        at = at[w[a[at] + t] == w[b[at] + t]]
        t += 1
        out[at] = t
        at = at[most[at] > t]
    return out


class Texts:
    """Numbered words of several texts, each closed by a 0."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.zeros(int((self.sizes + 1).sum()) + PERIOD, np.int64)
        for start, x in zip(self.starts, texts):
            self.words[start : start + len(x)] = x
        self.length = len(self.words) - PERIOD
        self.text_of = np.repeat(np.arange(len(texts)), self.sizes + 1)
        self.residue = (np.arange(self.length) - self.starts[self.text_of]) % PERIOD

    def reversed(self) -> Texts:
        return Texts([self.words[s : s + n][::-1] for s, n in zip(self.starts[::-1], self.sizes[::-1])])

    def mirror(self, at: np.ndarray) -> np.ndarray:
        """The place in the reversed texts of the word before `at`; of a text's first word, that of a 0."""
        return (self.length - 1 - at) % self.length


class Extensions:
    """Longest common extensions to the right between places of one text."""

    def __init__(self, texts: Texts):
        self.texts, w = texts, texts.words
        self.places = np.flatnonzero(_IN[texts.residue])
        self.number = np.full(texts.length, -1)
        self.number[self.places] = np.arange(len(self.places))
        owner = texts.text_of[self.places]
        self.rank = np.searchsorted(owner, owner)  # so far all suffixes of a text tie
        tied = np.arange(len(self.places))
        bits = max(1, int(w.max(initial=0)).bit_length())
        done, step = 0, max(1, 62 // bits)
        while done < PERIOD and len(tied):  # the words up to the next place of the cover
            key = np.zeros(len(tied), np.int64)
            for t in range(done, min(PERIOD, done + step)):
                key = (key << bits) | w[np.minimum(self.places[tied] + t, len(w) - 1)]
            tied, done = self._split(tied, key), done + step
        levels, length = [], PERIOD
        while len(tied):  # twice as many words by the ranks of what follows
            levels.append((length, self.rank.copy()))
            tied, length = self._split(tied, self.rank[self.number[self.places[tied] + length]]), 2 * length
        self.table = self._ranges(self._neighbours(levels, owner), int(np.bincount(owner).max(initial=1)))

    def _split(self, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Rank tied suffixes by the key, and return those that still tie."""
        order = np.lexsort((key, self.rank[tied]))
        tied, key, old = tied[order], key[order], self.rank[tied][order]
        at = np.arange(len(tied))
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(part, at, 0))
        self.rank[tied] = old + first - np.maximum.accumulate(np.where(group, at, 0))
        return tied[~(part & np.append(part[1:], True))]

    def _neighbours(self, levels: list[tuple[int, np.ndarray]], owner: np.ndarray) -> np.ndarray:
        """The common prefix of each sorted suffix with the one before it, 0 between texts."""
        order = np.empty(len(self.places), np.int64)
        order[self.rank] = np.arange(len(self.places))
        out = np.zeros(len(order), np.int64)
        at = np.flatnonzero(owner[order[1:]] == owner[order[:-1]]) + 1
        a, b, length = self.places[order[at - 1]], self.places[order[at]], np.zeros(len(at), np.int64)
        for step, rank in reversed(levels):
            equal = rank[self.number[a + length]] == rank[self.number[b + length]]
            length[equal] += step
        out[at] = length + _same(self.texts.words, a + length, b + length, np.full(len(at), PERIOD))
        return out

    @staticmethod
    def _ranges(values: np.ndarray, most: int) -> list[np.ndarray]:
        """Least values of the ranges of 1, 2, 4, .. from each place on, up to `most` long."""
        table = [values]
        while 2 << (len(table) - 1) <= most:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from a and from b on."""
        out, reached = _few(self.texts, a, b)
        far = np.flatnonzero(reached)
        one, two = self.rank[self.number[a[far] + out[far]]], self.rank[self.number[b[far] + out[far]]]
        low, high = np.minimum(one, two) + 1, np.maximum(one, two)
        level = np.frexp(high - low + 1)[1] - 1
        least = np.zeros(len(far), np.int64)
        for k in np.unique(level):
            at = level == k
            least[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k)) + 1])
        out[far] += least
        return out


def _grid(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a and periods p of all neighbours a, a + p of the texts' grids that hold equal words."""
    half = texts.sizes // 2
    text = np.repeat(np.arange(len(half)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    pairs = (texts.sizes[text] - 1) // np.maximum(period, 1)
    upto = np.cumsum(pairs)
    start = 0
    while start < len(text):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        n = pairs[start:end]
        p = np.repeat(period[start:end], n)
        a = np.repeat(texts.starts[text[start:end]], n) + (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * p
        equal = np.flatnonzero(texts.words[a] == texts.words[a + p])
        yield a[equal], p[equal]
        start = end


def _stretches(a: np.ndarray, p: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """start, length and period of the stretches of period p around a and a + p that are 2 p long or longer."""
    long = after + before >= p
    return np.stack([(a - before)[long], (after + before + p)[long], p[long]])


def _few(texts: Texts, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of equal words from a and from b on, up to the cover, and whether they reach it."""
    shift = _SHIFT[texts.residue[a], texts.residue[b]]
    out = _same(texts.words, a, b, shift)
    return out, out == shift


def runs_of(sequences: list[np.ndarray], min_length: int = 12) -> list[np.ndarray]:
    """The runs of each sequence of numbers from 1 on: rows start, length, period by start, then period."""
    texts = Texts(sequences)
    mirrored, far, found = texts.reversed(), np.zeros(len(sequences), bool), [np.zeros((3, 0), np.int64)]
    for a, p in _grid(texts):
        (after, right), (before, left) = _few(texts, a, a + p), _few(mirrored, texts.mirror(a), texts.mirror(a + p))
        far[texts.text_of[a[right | left]]] = True
        found.append(_stretches(a, p, after, before))
    found = [x[:, ~far[texts.text_of[x[0]]]] for x in found]
    # Texts of which a comparison reached the cover are extended by their sorted suffixes.
    some = np.flatnonzero(far)
    if len(some):
        part = Texts([sequences[k] for k in some])
        right, left = Extensions(part), Extensions(part.reversed())
        for a, p in _grid(part):
            x = _stretches(a, p, right(a, a + p), left(part.mirror(a), part.mirror(a + p)))
            k = part.text_of[x[0]]
            x[0] += texts.starts[some[k]] - part.starts[k]
            found.append(np.unique(x, axis=1))
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    order = order[length[order] >= min_length]
    start, length, period = start[order], length[order], period[order]
    # Of one stretch's periods the smallest counts.
    first = np.diff(start, prepend=-1).astype(bool) | np.diff(length, prepend=-1).astype(bool)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    owner = texts.text_of[start]
    rows = np.stack([start - texts.starts[owner], length, period], 1)
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(sequences))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Row ranges of about BLOCK_WORDS words with their words."""
    start, held, n = 0, [], 0
    for row, text in enumerate(texts):
        words = (text.as_py() or "").encode().split()
        if held and n + len(words) > BLOCK_WORDS:
            yield start, row, held
            start, held, n = row, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield start, start + len(held), held


def find(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_length: int = 12) -> DataFrame:
    """`df`, or its columns `keep`, with `runs`, an array of (start, length, period) by start, then period, and
    `collapsed`: the words that no run repeats, joined by one space."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.select(kept)
            for start, end, held in _blocks(batch.column(batch.schema.get_field_index(text_col))):
                numbers: dict[bytes, int] = defaultdict(count(1).__next__)
                sequences = [np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in held]
                found = runs_of(sequences, min_length)
                collapsed = []
                for words, runs in zip(held, found):
                    stay = words if not len(runs) else [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                    collapsed.append(b" ".join(stay))
                rows = np.concatenate(found)
                structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=RUN.names)
                offsets = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([*whole.slice(start, end - start).columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)
            trim()

    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def made_periodic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df`, where a tenth of the texts repeats from some word on, with a place and period that follow from the id
    alone. Rows without id and texts without words stay as they are."""
    h, text = F.crc32(F.col(id_col).cast("string").cast("binary")), F.coalesce(F.col(text_col), F.lit(""))

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " "))

    periodic = bind(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeat)
    return df.withColumn(text_col, F.when(h % 10 == 0, F.coalesce(periodic, text)).otherwise(F.col(text_col)))


def digests(df: DataFrame) -> DataFrame:
    """The number of runs, the longest one (then the first, then of the smallest period), and digests of all runs and
    of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    x = df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return x.select(
        "doc_id", "n_runs", F.col("x.start").alias("start"), (-F.col("x.shortness")).alias("length"), F.col("x.period").alias("period"),
        F.expr("(-1000 * x.shortness) div x.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
