"""WARC archives as a Spark data source.

A record is one gzip member whose header holds the member's length (the ``sl`` extra
field of the WARC format's gzip annex), so a reader can go on to the next record
without inflating this one. Writers note where they could be entered; the committed
list of files and entry points is what a scan is planned from.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from ..session import work_dir

MANIFEST = "_records.json"
#: Compressed bytes between two entry points of a file.
SPLIT_BYTES = 8 << 20
#: Rows, or bytes of payload, that a reader hands on at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Fixed values of the format.
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
DATE = "1970-01-01T00:00:00Z"

SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, warc_date string, "
    "payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
)
ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()),
    ("refers_to", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()),
])
#: Columns that a header answers, so that filters on them need no payload.
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path in it; executors open it as the driver does."""
    if re.match("file:", path):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, key: object, url: str | None, payload: bytes, digest: str, refers: object) -> bytes:
    """A response with its payload, or a revisit that only names the record that has it."""
    def name(x: object) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{x}')}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(key)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if key is not None:
        head.append(("X-Record-Key", key))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", name(refers))]
        if refers is not None:
            head.append(("X-Refers-To-Key", refers))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that says how long it is."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(GZIP_HEAD) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return GZIP_HEAD + struct.pack("<H", len(extra)) + extra + body + struct.pack(
        "<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    file: str
    entries: list[int]


@dataclass
class Span(InputPartition):
    file: str
    start: int
    stop: int | None


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; option ``path``.

    Read option ``payload=false`` leaves payloads unread. Rows to write have record_type,
    record_key, target_uri, payload, payload_digest and refers_to_key.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcWriter(DataSourceArrowWriter):
    """One file per task; only files of tasks that were committed are ever read."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        file, entries, at = f"part-{uuid.uuid4().hex}.warc.gz", [], 0
        with store.open_output_stream(f"{root}/{file}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = member(record_bytes(row["record_type"], row["record_key"], row["target_uri"],
                                               row["payload"] or b"", row["payload_digest"], row["refers_to_key"]))
                    if not entries or at - entries[-1] >= SPLIT_BYTES:
                        entries.append(at)
                    out.write(data)
                    at += len(data)
        return Written(file, entries)

    def commit(self, messages: list) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files = {}
        if store.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            files = json.loads(store.open_input_stream(f"{root}/{MANIFEST}").read())
        files |= {m.file: m.entries for m in messages if m is not None and m.entries}
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.file}")


class WarcReader(DataSourceReader):
    """A partition per entry point; headers are parsed, and filtered on, before payloads are inflated."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                values = (f.value,) if isinstance(f, EqualTo) else f.value
                self.wanted.append((HEADER_OF[f.attribute[0]], frozenset(values)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        store, root = open_store(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            files = json.loads(store.open_input_stream(f"{root}/{MANIFEST}").read())
        else:  # archives from elsewhere: a partition per file
            found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
            files = {x.path[len(root):].lstrip("/"): [0] for x in found if re.search(r"\.warc(\.gz)?$", x.path) and x.size}
        spans = [Span(f, a, b) for f, at in files.items() for a, b in zip(at, [*at[1:], None])]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = open_store(self.path)
        rows, held = [], 0
        with store.open_input_file(f"{root}/{partition.file}") as source:
            walk = gzip_records if partition.file.endswith(".gz") else plain_records
            for offset, headers, payload in walk(source, partition.start, partition.stop, self.wants, self.payload):
                values = {column: headers.get(head) for column, head in HEADER_OF.items()}
                rows.append({"file": partition.file, "offset": offset, **values, "payload": payload,
                             "content_length": int(headers.get("content-length", 0)), "headers": list(headers.items())})
                held += len(payload or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def wants(self, headers: dict[str, str]) -> bool:
        return all(headers.get(name) in values for name, values in self.wanted)


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def gzip_records(source, start, stop, wants, with_payload):
    """Records of gzip members from ``start`` up to ``stop``."""
    at, end = start, stop if stop is not None else source.size()
    while at < end:
        source.seek(at)
        head = source.read(12)
        if len(head) < 12 or head[:3] != GZIP_HEAD[:3]:
            raise ValueError(f"no gzip member at byte {at}")
        skip, size = 10, None
        if head[3] & 4:
            length = struct.unpack("<H", head[10:12])[0]
            extra, skip = source.read(length), 12 + length
            while len(extra) >= 4:
                kind, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if kind == b"sl" and n == 8:
                    size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n:]
        if head[3] & ~4:
            skip, size = 0, None  # names or comments: let zlib read the header
        inflate = zlib.decompressobj(31 if not skip else -15)
        source.seek(at + skip)
        text, chunk = b"", b""
        while b"\r\n\r\n" not in text and not inflate.eof:
            chunk = inflate.unconsumed_tail or source.read(4096)
            if not chunk:
                raise ValueError(f"archive breaks off in the record at byte {at}")
            text += inflate.decompress(chunk, 4096)
        head_end = text.index(b"\r\n\r\n")
        headers = parse_head(text[:head_end])
        wanted = wants(headers)
        if wanted and with_payload or size is None:
            parts = [text[head_end + 4:]]
            while not inflate.eof:
                chunk = inflate.unconsumed_tail or source.read(65536)
                if not chunk:
                    raise ValueError(f"archive breaks off in the record at byte {at}")
                parts.append(inflate.decompress(chunk))
            if size is None:
                size = source.tell() - at - len(inflate.unused_data) + (8 if skip else 0)
            block = b"".join(parts)[:int(headers.get("content-length", 0))]
        if wanted:
            yield at, headers, payload_of(headers, block) if with_payload else None
        at += size


def plain_records(source, start, stop, wants, with_payload):
    """Records of an archive that is not compressed."""
    at, end = start, stop if stop is not None else source.size()
    while at < end:
        source.seek(at)
        text = b""
        while b"\r\n\r\n" not in text:
            chunk = source.read(4096)
            if not chunk:
                if text.strip():
                    raise ValueError(f"archive breaks off in the record at byte {at}")
                return
            text += chunk
        head_end = text.index(b"\r\n\r\n") + 4
        headers = parse_head(text[:head_end])
        size = int(headers.get("content-length", 0))
        if wants(headers):
            payload = None
            if with_payload:
                source.seek(at + head_end)
                payload = payload_of(headers, source.read(size))
            yield at, headers, payload
        at += head_end + size + 4


def base32_of_hex(hexed):
    """Upper-case base32 of 40 hex digits: five of them are four digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexed, i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, key: str, url: str, body: str, least: int = 0) -> None:
    """Write a record per row of ``pages`` below ``path``.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest
    ``key`` become responses, the others revisits of it. Null payloads are empty ones; a
    null key is smaller than any other. Equal rows are records of their own, so several
    rows with the largest key are all responses. Only digests and keys are grouped; the
    payload moves once, to join what was found (Spark splits a skewed digest).
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    rows = pages.select(
        F.col(key).alias("record_key"), F.col(url).alias("target_uri"),
        F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    first = rows.groupBy("_sha").agg(F.max("record_key").alias("_keep"))
    again = (F.length("payload") >= least) & ~F.col("record_key").eqNullSafe(F.col("_keep"))
    rows.join(first, "_sha").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "record_key", "target_uri", "payload",
        base32_of_hex(F.col("_sha")).alias("payload_digest"), F.when(again, F.col("_keep")).alias("refers_to_key"),
    ).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``; with ``payload`` off, payloads are null and never inflated.

    Filters on type, id, URI, date, digest and reference are answered from the header.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back, and describe each record."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_warc(pages, path, "page_id", "url", "html")
    key = F.col("headers")["x-record-key"].cast("long").alias("page_id")
    whole = read_warc(spark, path).where("record_type = 'response'").select(
        key, F.length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        key, F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"),
        F.expr("substr(payload_digest, 6)").alias("payload_digest"), "record_type",
        F.col("headers")["x-refers-to-key"].cast("long").alias("refers_to"))
    return whole.unionByName(again)


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h),
d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1), '' ORDER BY i) AS b
  FROM k, range(32) t(i) GROUP BY h
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN k USING (h) JOIN d USING (h)
"""
