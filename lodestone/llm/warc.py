"""WARC archives as seekable Zstandard bundles.

Records are packed into independent frames of about `frame_bytes`; a bundle is one .warc.zst file that
ends with a skippable frame, which holds the seek table (compressed and plain size of every frame). An
index maps each record to its bundle, its frame and the offset inside it. Tasks write bundles to a shared
folder and commit their index rows with the index table; a file that a lost task left behind is in no
committed row, and reading skips it.

Of pages with equal payloads of at least `min_bytes` the one with the smallest page id is written as
response, the others as revisits that refer to it. A record's id comes from its page id, its digest and
its row's place in the input, so rows that repeat an id, or everything, have records of their own.

Defined cases: a null html is an empty payload; rows that repeat the smallest page id are all
responses; in a group with only null ids all rows are responses, and otherwise null ids are revisits;
null or unprintable URLs are written percent-encoded; an empty table gives no bundle; other columns
are ignored. A payload is never cut; one larger than a frame has a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.skew import join_groups
from lodestone.tables import materialize

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "record_id string, bundle_id string, frame int, offset long, bytes long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, bundle_id string, frame int, offset long"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-page")


def _placed(pages: DataFrame) -> DataFrame:
    """`pages` with `_row`, each row's place: in its file, or in a copy where it does not come from files."""
    try:
        return pages.select("*", F.concat_ws("/", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias("_row"))
    except AnalysisException:
        return materialize(pages.withColumn("_row", F.monotonically_increasing_id().cast("string")), "pages")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, row, payload (null for revisits), payload_bytes, sha1, refers_to, refers_row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = _placed(pages.select(id_col, url_col, html_col)).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col("_row").alias("row"), html.cast("binary").alias("payload"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    keys = ["sha1", "payload_bytes"]
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col("page_id").isNull().alias("lacks"), "page_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    rows = join_groups(rows, materialize(first, "payloads"), keys, "copies", pages.count())
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.select("page_id", "url", "row", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "sha1", F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.row")).alias("refers_row"))


def _record_id(page_id: int | None, sha1: str, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{sha1}/{row}')}>"


def _record(page_id, url, row, payload, payload_bytes, sha1, refers_to, refers_row, date) -> tuple[str, bytes]:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    name = _record_id(page_id, sha1, row)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, sha1, refers_row)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Bundle:
    """Collects records into frames; holds one open frame and the compressed ones."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.frames, self.sizes, self.index, self.open, self.plain, self.total = frame_bytes, [], [], [], [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        if self.plain and self.plain + len(record) > self.frame_bytes:
            self.close()
        self.index.append((name, len(self.frames), self.plain, len(record)))
        self.open.append(record)
        self.plain += len(record)
        self.total += len(record)

    def close(self) -> None:
        frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.plain))
        self.open, self.plain = [], 0

    def finish(self) -> bytes:
        """The archive, with its footer."""
        if self.open:
            self.close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def write_archives(records: DataFrame, folder: str, frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The index (INDEX_SCHEMA) of the bundles <folder>/<bundle_id>.warc.zst, which tasks write through pyarrow's
    file systems; each packs the records of its partition in their order. A bundle's name comes from its
    content, so a task that runs twice writes the same file or one that no index row names."""
    columns = ("page_id", "url", "row", "payload", "payload_bytes", "sha1", "refers_to", "refers_row")
    context = records.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder.removeprefix("file:") if folder.startswith("file:/") else folder)

        def put(bundle: _Bundle) -> pa.RecordBatch:
            archive = bundle.finish()
            name = hashlib.sha256(archive).hexdigest()[:32]
            part = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(archive)
            store.move(part, f"{base}/{name}.warc.zst")
            ids, frames, offsets, sizes = zip(*bundle.index)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([name] * len(ids), pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["record_id", "bundle_id", "frame", "offset", "bytes"])

        bundle = _Bundle(frame_bytes)
        for batch in batches:
            values = [batch.column(c) for c in columns]
            for i in range(batch.num_rows):
                bundle.add(*_record(*[c[i].as_py() for c in values], date))
                if bundle.total >= bundle_bytes:
                    yield put(bundle)
                    bundle = _Bundle(frame_bytes)
        if bundle.total:
            yield put(bundle)

    return materialize(records.select(*columns).mapInArrow(run, INDEX_SCHEMA), "index")


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed size, plain size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries = archive[-9 - n * width : -9]
    out, at = [], 0
    for k in range(n):
        size, plain = struct.unpack_from("<II", entries, k * width)
        out.append((at, size, plain))
        at += size
    return out


def frame(archive: bytes, entry: tuple[int, int, int]) -> bytes:
    at, size, plain = entry
    return zstandard.ZstdDecompressor().decompress(archive[at : at + size], max_output_size=plain)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def fetch(archive: bytes, entry) -> tuple[dict[str, str], bytes]:
    """The record of an index row, decompressing its frame alone."""
    plain = frame(archive, seek_table(archive)[entry["frame"]])
    return parse_record(plain[entry["offset"] : entry["offset"] + entry["bytes"]])


def _split(plain: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of the records of a frame."""
    at = 0
    while at < len(plain):
        head = plain.index(b"\r\n\r\n", at) + 4
        end = head + int(plain[at:head].rpartition(b"Content-Length: ")[2]) + 4
        yield at, *parse_record(plain[at:end])
        at = end


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """RECORD_SCHEMA rows of all records of the bundles that the index names; a response whose payload does
    not match its digest or length stops the job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("record_id", pa.string()), ("refers_to_record", pa.string()), ("bundle_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for i in range(batch.num_rows):
                archive, name = batch.column("content")[i].as_py(), batch.column("path")[i].as_py().rpartition("/")[2].partition(".")[0]
                for k, entry in enumerate(seek_table(archive)):
                    out = []
                    for offset, headers, payload in _split(frame(archive, entry)):
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(headers["X-Payload-Length"])):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        out.append((number(headers["X-Page-Id"]), headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], number(headers.get("X-Refers-To-Page-Id")), headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), name, k, offset))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA).join(index.select("bundle_id").distinct(), "bundle_id", "left_semi")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""
