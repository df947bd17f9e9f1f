"""Token counts: batch encoding in Arrow functions that return lengths only.

A group of texts of at most about GROUP_BYTES is cut at safe boundaries, and the pieces that it does not
know yet are encoded in batches of at most BATCH_BYTES; what returns is the sum of each text's lengths. A
boundary is safe where no token can reach over it, so the sum equals the length of the whole text: between a
character that is no white space and one that is, as a pre-token has white space at its start only. Pieces
longer than LONG_PIECE are also cut before a comma or full stop of East Asian text.

A task streams its rows: it holds one group, one batch's encodings and the lengths of KNOWN_PIECES at most.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; ids, repeated rows and other columns pass
through untouched; an empty table gives an empty result; texts are counted whole, however long. The result
columns `n_bytes` and `n_tokens` replace columns of the same names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import S, _tokenizer
from lodestone.llm.memory import trim

GROUP_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
#: Lengths that a worker remembers; all are forgotten together.
KNOWN_PIECES = 400_000
LONG_PIECE = 1 << 14

PIECES = re.compile(rf"[{S}]*[^{S}]+|[{S}]+")
#: Kana, Han and Hangul before a comma or full stop, which starts a pre-token of its own.
EAST_ASIAN = re.compile(r"(?<=[ぁ-ゖァ-ヺ一-龥가-힣])(?=[、。，．])")


def pieces(text: str) -> list[str]:
    """The text cut at safe boundaries, long pieces at more of them."""
    found = PIECES.findall(text)
    if len(text) > LONG_PIECE and max(map(len, found)) > LONG_PIECE:
        found = [p for x in found for p in (EAST_ASIAN.split(x) if len(x) > LONG_PIECE else [x])]
    return found


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a larger row is a range of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, end
        start = end


def lengths(distinct: list[str], source: str) -> Iterator[int]:
    """The number of tokens of each piece, encoded in batches balanced by bytes."""
    for start, end in groups(np.fromiter((len(x.encode()) for x in distinct), np.int64, len(distinct)), BATCH_BYTES):
        yield from (len(x) for x in _tokenizer(source).encode_batch_fast(distinct[start:end], add_special_tokens=False))


def count(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df`, or its columns `keep`, with `n_bytes` (UTF-8) and `n_tokens` of the text. `vocabulary` is the path, on
    the driver, of a byte-level BPE file of the tokenizers library."""
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("n_bytes", "n_tokens")]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            tokens = np.zeros(len(texts), np.int64)
            for start, end in groups(sizes, GROUP_BYTES):
                cut = [pieces(x) for x in texts.slice(start, end - start).to_pylist()]
                if len(known) > KNOWN_PIECES:
                    known.clear()
                new = list(set(itertools.chain.from_iterable(cut)).difference(known))
                known.update(zip(new, lengths(new, source)))
                tokens[start:end] = [sum(map(known.__getitem__, x)) for x in cut]
            whole = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(sizes), pa.array(tokens)], names=schema.names)
            trim()

    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)
