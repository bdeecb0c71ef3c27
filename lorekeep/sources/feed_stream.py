"""The article feed as a Python data source, as a batch and as a stream.

A stream's offset is the name of the last file taken: files come in the order of their names, a
bounded number at a time, and only names behind the offset count. Each file is a
partition that one task inflates as it reads, record by record; no file is ever one string.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .articles import RECORD_END
from .files import file_entries, open_store

SUFFIX = ".xml.gz"
FILES_PER_BATCH = 1_000
#: Bytes read at a time, and bytes of records handed on at a time.
READ_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
_END = RECORD_END.encode()
_LOOSE = re.compile(rb"</PubmedArticle\s+>")
_SCHEMA = pa.schema([("feed_file", pa.string()), ("feed_pos", pa.int64()), ("value", pa.string())])


class FeedFile(InputPartition):
    def __init__(self, name: str, uri: str):
        super().__init__(name)
        self.name, self.uri = name, uri


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, as far as they are sound."""
    inflate = zlib.decompressobj(31)
    while block := source.read(READ_BYTES):
        while block:
            try:
                yield inflate.decompress(block)
            except zlib.error:
                return
            block = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
                if not block.strip(b"\0"):
                    break


def pieces_of(source) -> Iterator[str]:
    """What stands between the end tags of records, and what follows the last one."""
    held = b""
    for block in inflated(source):
        # An end tag may begin in what is held already.
        from_ = max(0, len(held) - len(_END))
        held += block
        if held.find(_END, from_) < 0:
            continue
        *whole, held = held.split(_END)
        for piece in whole:
            for part in _LOOSE.split(piece):
                yield part.decode("utf-8", "replace")
    if held:
        for part in _LOOSE.split(held):
            yield part.decode("utf-8", "replace")


class _Reading:
    """Listing and reading, the same for batch and stream."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.suffix = options.get("suffix", SUFFIX)

    def names(self, after: str, upto: str | None = None) -> list[str]:
        """Names behind ``after`` in code-point order; the folder is listed, no file is opened.

        The list of a feed's files is what the driver holds, as it does for any file source.
        """
        system, base, _ = open_store(self.path)
        found = (path.rpartition("/")[2] for path, is_file, _, _ in file_entries(system, base) if is_file)
        return sorted(n for n in found if n.endswith(self.suffix) and n > after and (upto is None or n <= upto))

    def files(self, after: str, upto: str | None = None) -> list[FeedFile]:
        return [FeedFile(n, f"{self.path}/{n}") for n in self.names(after, upto)]

    def read(self, partition: FeedFile) -> Iterator[pa.RecordBatch]:
        """feed_file, feed_pos (from 0) and value. A file without any text gives one row whose value is null."""
        system, path, _ = open_store(partition.uri)
        rows, size, at = [], 0, 0

        def batch() -> pa.RecordBatch:
            places = pa.array(range(at - len(rows), at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([partition.name] * len(rows)), places, pa.array(rows, pa.string())], schema=_SCHEMA)

        with system.open_input_stream(path, compression=None) as source:
            for piece in pieces_of(source):
                rows.append(piece)
                size, at = size + len(piece), at + 1
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if not at:
            rows, at = [None], 1
        if rows:
            yield batch()


class FeedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[FeedFile]:
        return self.files("")


class FeedStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.limit = int(options.get("maxfilesperbatch", FILES_PER_BATCH))
        self.begin = options.get("after", "")
        self.at = options.get("position") or self.begin

    def initialOffset(self) -> dict:
        """Where a new stream begins. It is asked again if the first batch is repeated, so it is not the position."""
        return {"file": self.begin}

    def latestOffset(self) -> dict:
        """The name that ends the next batch; it is asked again until that batch is planned."""
        names = self.names(self.at)[:self.limit]
        return {"file": names[-1] if names else self.at}

    def partitions(self, start: dict, end: dict) -> list[FeedFile]:
        self.at = max(self.at, end["file"])
        return self.files(start["file"], end["file"])

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["file"])


class FeedSource(DataSource):
    """Format ``article_feed``. Options: ``suffix``; for a stream ``maxFilesPerBatch``, ``after`` (where a new
    stream begins) and ``position`` (where the last batch that was planned ends).
    """

    @classmethod
    def name(cls) -> str:
        return "article_feed"

    def schema(self) -> str:
        return "feed_file string, feed_pos long, value string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


def load_feed_pieces(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """All record pieces of a feed folder."""
    spark.dataSource.register(FeedSource)
    return spark.read.format("article_feed").option("suffix", suffix).load(path)


def stream_feed_files(
    spark: SparkSession, path: str, checkpoint: str | None = None, after: str | None = None,
    max_files: int = FILES_PER_BATCH, suffix: str = SUFFIX,
) -> DataFrame:
    """The same as a stream of files behind ``after``, ``max_files`` a batch.

    A stream that goes on from ``checkpoint`` begins where that one ended. With a new one, ``after`` is the
    last file of an earlier run (``sync_state``). Names that come late, before
    the offset, are never read: the file stream of ``sources.articles`` takes those as well.
    """
    spark.dataSource.register(FeedSource)
    position = last_offset(spark, checkpoint) if checkpoint else None
    options = {"suffix": suffix, "maxFilesPerBatch": str(max_files), "after": after or "", "position": position or ""}
    return spark.readStream.format("article_feed").options(**options).load(path)


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The file with which the last planned batch of a checkpoint ends; None before the first."""
    batch = F.element_at(F.split("_metadata.file_path", "/"), -1).cast("bigint")
    try:
        lines = spark.read.option("pathGlobFilter", "[0-9]*").text(f"{checkpoint.rstrip('/')}/offsets")
        found = lines.where(F.startswith("value", F.lit('{"file"'))).agg(F.max_by("value", batch)).first()[0]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(found)["file"] if found else None
