"""WARC records in seekable Zstandard bundles.

Each task writes its records to bundles: records are grouped into frames of about ``FRAME_BYTES``, each frame is
an independent Zstandard frame, and a bundle ends with the seek table of the public seekable format (a skippable
frame: compressed and decompressed size of each frame). The index table maps every record to its bundle, its frame
and its offset inside the decompressed frame, so one record is read with one seek and one small decompression.

Files go to a folder that all executors share, by pyarrow's file systems (local paths, ``hdfs://``, ``s3://``).
A bundle's name holds the task attempt, it appears under its final name only when complete, and only bundles of
attempts that Spark accepted are in the index: a lost executor's half-written or repeated bundles are never read.

Duplicates: of records with equal payloads of at least ``min_bytes`` the one with the largest page id is a
response, the others are revisits that refer to it and carry no payload. Equal means equal SHA-1 and length.

Defined results: a null payload is empty; a null url gives a record without target URI (spaces,
control and non-ASCII characters of a url are percent-encoded and come back so); a null page id is never the
largest (if a group has no other, all of it are responses); rows that repeat the largest page id are all responses.
An empty table gives no bundle and an empty result. Records are never held beyond one frame (at least one record).
"""

from __future__ import annotations

import io
import string
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import file_system

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
# The public seekable format of Zstandard.
SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
# WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html -> page_id, url, payload, digest, record_type, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    groups = rows.filter(F.col("n") >= min_bytes).groupBy("digest", "n").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND kept IS NOT NULL")
    rows = rows.join(groups, ["digest", "n"], "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("kept")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    value = record_id.rpartition(":")[2].rstrip(">")
    return int(value) if value else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=string.punctuation)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if line)


def decode_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record in a decompressed frame or one record's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = _headers(data[at:end])
        stop = end + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", end, stop) + 4
        yield head, _headers(data[end:body]), data[body:stop]
        at = stop + 4


class _Bundle:
    """One seekable file; frames are written as they fill up."""

    def __init__(self, folder: str) -> None:
        store, path = file_system(folder)
        self.store, self.name = store, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
        self.final = f"{path.rstrip('/')}/{self.name}"
        store.create_dir(path, recursive=True)
        self.out = store.open_output_stream(self.final + ".part", compression=None)
        self.packer, self.frames, self.offset = zstandard.ZstdCompressor(level=3), [], 0
        self.buffer, self.pending = io.BytesIO(), []

    def add(self, page_id: int | None, record: bytes) -> Iterator[tuple]:
        self.pending.append((page_id, self.buffer.tell(), len(record)))
        self.buffer.write(record)
        if self.buffer.tell() >= FRAME_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.pending:
            return
        frame = self.packer.compress(self.buffer.getvalue())
        self.out.write(frame)
        for page_id, at, n in self.pending:
            yield page_id, self.name, len(self.frames), self.offset, len(frame), at, n
        self.frames.append((len(frame), self.buffer.tell()))
        self.offset += len(frame)
        self.buffer, self.pending = io.BytesIO(), []

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.store.move(self.final + ".part", self.final)


def read_seek_table(store: fs.FileSystem, path: str) -> list[tuple[int, int]]:
    """(compressed, decompressed) size of each frame, from the end of a bundle."""
    with store.open_input_file(path) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = f.read_at(8 * n, size - 9 - 8 * n)
    return [struct.unpack_from("<II", table, 8 * i) for i in range(n)]


_INDEX_COLUMNS = [f.split()[0] for f in INDEX.split(", ")]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if c == "bundle" else pa.int64() for c in _INDEX_COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_INDEX_COLUMNS)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows: list[tuple] = []
            for r in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")], strict=True):
                bundle = bundle or _Bundle(folder)
                page_id, *rest = (x.as_py() for x in r)
                rows += bundle.add(page_id, encode_record(page_id, *rest))
                if bundle.offset >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield _index_batch(rows)
        if bundle and (rows := list(bundle.close())):
            yield _index_batch(rows)

    return write


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records to ``folder/bundles`` and the index to ``folder/index``; returns the index."""
    spark = records.sparkSession
    records.mapInArrow(_writer(f"{folder}/bundles"), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _record_rows(records: Iterator) -> pa.RecordBatch:
    out = []
    for head, http, payload in records:
        kind = head["WARC-Type"]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        out.append({"page_id": _page_id(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": kind,
                    "refers_to": _page_id(head["WARC-Refers-To"]) if kind == "revisit" else None,
                    "payload_bytes": int(http["Content-Length"]) if kind == "revisit" else len(payload),
                    "payload_digest": digest, "payload": None if kind == "revisit" else payload})
    return pa.RecordBatch.from_pylist(out, schema=pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))


def _frame_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{path.rstrip('/')}/{r['bundle']}") as f:
                    data = unpacker.decompress(f.read_at(r["frame_bytes"], r["frame_offset"]))
                if r["spans"] is not None:  # only some records of the frame
                    for at, n in sorted({(s["record_offset"], s["record_bytes"]) for s in r["spans"]}):
                        yield _record_rows(decode_records(data[at:at + n]))
                else:
                    yield _record_rows(decode_records(data))

    return read


_SPANS = "array<struct<record_offset:long,record_bytes:long>>"


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records, read frame by frame; payloads of revisits are null."""
    frames = index.filter("record_offset = 0").select("bundle", "frame_offset", "frame_bytes", F.lit(None).cast(_SPANS).alias("spans"))
    return frames.repartition("bundle", "frame_offset").mapInArrow(_frame_reader(f"{folder}/bundles"), RECORD)


def lookup(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """Records of the given page ids (one column, ``page_id``): only their frames are read, each once."""
    wanted = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    frames = wanted.groupBy("bundle", "frame_offset", "frame_bytes").agg(
        F.collect_set(F.struct("record_offset", "record_bytes")).alias("spans"))
    return frames.mapInArrow(_frame_reader(f"{folder}/bundles"), RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Write all pages to bundles and read every record back."""
    folder = folder or scratch_path(spark, "warc")
    return read_bundles(write_bundles(plan_records(pages, min_bytes), folder), folder)
