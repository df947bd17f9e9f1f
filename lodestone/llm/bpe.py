r"""Byte-level BPE encoding and decoding over distinct-word tables.

Encoding: Spark splits each text into pre-token words with a regular expression. Every block of
documents (an Arrow batch) gets its distinct-word table; each distinct word is encoded once and its
ids are joined back by position. A word's ids depend on the word alone, so the result equals encoding
whole texts. Decoding joins every id with the vocabulary's id-to-piece table (50,257 rows here).

The word tables are per block, not one for the corpus: see the README for the disk a corpus-wide
table needs. Blocks need no shuffle, so a lost executor costs the rerun of its own blocks.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids, repeated rows and
other columns pass through untouched; an empty table gives an empty result; texts are never cut. The
result columns `ids` and `decoded` replace columns of the same names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.memory import trim

SPECIAL = r"<\|endoftext\|>"
#: Unicode's White_Space, which is what \s means to the tokenizer.
S = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's rule, for texts without and with the special token, which ends a piece of text.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[LETTER]+|\x20?[NUMBER]+|\x20?[^{S}LETTERNUMBER]+|[{S}]+(?![^{S}])|[{S}]+"
WORDS_SPECIAL = rf"{SPECIAL}|'s|'t|'re|'ve|'m|'ll|'d|\x20?[LETTER]+|\x20?[NUMBER]+|\x20?(?:(?!{SPECIAL})[^{S}LETTERNUMBER])++|[{S}]+(?!(?!{SPECIAL})[^{S}])|[{S}]+"
#: Words of one block, at most about; bounds a worker's memory.
BLOCK_WORDS = 300_000
#: Distinct words that go to the tokenizer at once; its results take far more memory than the ids.
ENCODE_WORDS = 10_000

_loaded: dict[int, object] = {}


def classes(source: str) -> tuple[str, str]:
    """Letters and numbers for the JVM's expressions. The tokenizer knows characters of later Unicode
    versions than the JVM does; they are found by asking it, and count where the JVM has none."""
    tokenizer = _tokenizer(source)
    # Planes 4 to 13 hold no characters.
    near = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0x110000)] if unicodedata.category(chr(c))[0] in "LN" or unicodedata.category(chr(c)) == "Cn"]
    out = []
    for base, known in (("a", r"\p{L}"), ("1", r"\p{N}")):
        joined = []
        for at in range(0, len(near), 4096):
            text = "".join(f"!{base}{c}" for c in near[at : at + 4096])
            joined += [ord(text[b - 1]) for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text) if b - a == 2 and text[a] == base]
        ends = [c for c, after in zip(joined, [*joined[1:], -1]) if after != c + 1]
        starts = [c for c, before in zip(joined, [-1, *joined]) if before != c - 1]
        out.append(known + "[\\p{Cn}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]]")
    return out[0], out[1]


def words(text: Column, letter: str = r"\p{L}", number: str = r"\p{N}") -> Column:
    """The pre-tokens of a text, whose concatenation is the text."""
    fill = lambda p: F.lit(p.replace("LETTER", letter).replace("NUMBER", number))
    return F.when(F.contains(text, F.lit("<|endoftext|>")), F.regexp_extract_all(text, fill(WORDS_SPECIAL), F.lit(0))).otherwise(F.regexp_extract_all(text, fill(WORDS), F.lit(0)))


def _tokenizer(source: str):
    """One tokenizer a worker process and vocabulary."""
    if (key := hash(source)) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[key] = tokenizer
    return _loaded[key]


def _encoded(distinct: pa.Array, source: str) -> pa.Array:
    """The ids of each distinct word as little-endian unsigned 32-bit integers."""
    sizes, flat = [np.zeros(1, np.int64)], []
    for at in range(0, len(distinct), ENCODE_WORDS):
        ids = [x.ids for x in _tokenizer(source).encode_batch_fast(distinct.slice(at, ENCODE_WORDS).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter((i for x in ids for i in x), "<u4", int(sizes[-1].sum())))
    offsets = 4 * np.cumsum(np.concatenate(sizes))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat) if flat else b"")])


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_WORDS words; a longer text is a block of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_WORDS, "right")) - 1)
        yield start, end
        start = end


def _cut(joined: pa.Array, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The joined pieces as one value per document; offsets count pieces."""
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[offsets])), joined.buffers()[2] if len(joined) else pa.py_buffer(b"")])


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df`, or its columns `keep`, with `ids`: the token ids as little-endian unsigned 32-bit integers in
    one binary value. `vocabulary` is the path, on the driver, of a byte-level BPE file of the
    tokenizers library."""
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    own = "_words"
    while own in df.columns:
        own += "_"
    kept = [c for c in df.columns if c != "ids"] if keep is None else keep
    rows = df.select(*kept, words(F.coalesce(F.col(text_col), F.lit("")), *classes(source)).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(own))
            offsets = np.asarray(column.offsets, np.int64)
            for start, end in _blocks(offsets):
                table = column.values.slice(offsets[start], offsets[end] - offsets[start]).cast(pa.large_string()).dictionary_encode()
                joined = _encoded(table.dictionary, source).take(table.indices)
                ids = _cut(joined, offsets[start : end + 1] - offsets[start], pa.large_binary())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], ids.cast(pa.binary())], names=[*kept, "ids"])
            trim()

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("ids", T.BinaryType())]))


def pieces(vocabulary: str) -> list[bytes]:
    """The id-to-piece table: each token's bytes, by id."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    # Byte-level vocabularies write the printable bytes of Latin-1 as themselves and the rest as U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {b: b for b in shown} | {0x100 + k: b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [bytes(back[ord(c)] for c in names[i]) for i in range(len(names))]


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `decoded`, the text of its ids."""
    table = pieces(vocabulary)
    rows = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = pa.array(table, pa.large_binary())
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col)).cast(pa.large_binary())
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) // 4)])
            for start, end in _blocks(bounds):
                part = batch.slice(start, end - start)
                ids = np.frombuffer(b"".join(x.as_py() or b"" for x in column.slice(start, end - start)), "<u4")
                joined = lookup.take(pa.array(ids))
                raw = _cut(joined, bounds[start : end + 1] - bounds[start], pa.large_binary())
                try:
                    text = raw.cast(pa.large_string())
                except pa.ArrowInvalid:  # ids that do not form whole characters
                    text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=[*part.schema.names, "decoded"])
            trim()

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("decoded", T.StringType())]))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    return df.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
