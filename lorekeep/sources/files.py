"""Listing and reading files of any name, in tasks.

Spark's own listing leaves out empty files and names that begin with ``.`` or ``_``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

ENTRY = "path string, uri string, is_file boolean, size long, modified_at timestamp"
#: Hadoop's names of stores that Arrow knows by another.
HADOOP_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Rows, or bytes of content, that a task hands on at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def open_store(path: str):
    """The file system of ``path``, the path in it, and what stands before it in a URI."""
    from pyarrow import fs

    local = re.match(r"(file:(?://)?)(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[2], local[1]
    if "://" in path:
        scheme, rest = path.split("://", 1)
        system, base = fs.FileSystem.from_uri(f"{HADOOP_SCHEMES.get(scheme, scheme)}://{rest}")
        return system, base, path[: len(path) - len(base)] if path.endswith(base) else ""
    return fs.LocalFileSystem(), path, ""


def file_entries(system, folder: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
    """(path, is_file, size, mtime) of a folder's entries; a local folder of any size is streamed."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for e in found:
                    info = e.stat()
                    yield e.path, e.is_file(), info.st_size, info.st_mtime
        except FileNotFoundError:
            return
    else:
        for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield i.path, i.is_file, i.size, i.mtime.timestamp() if i.mtime else None


def _lister(root: str, recursive: bool, skip: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = open_store(root)[1].rstrip("/")
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["path", "uri", "is_file", "size", "modified_at"])
            out["size"] = out["size"].astype("Int64")
            out["modified_at"] = pd.to_datetime(out["modified_at"], utc=True)
            rows.clear()
            return out

        for batch in batches:
            for folder in batch["folder"]:
                system, base, scheme = open_store(folder)
                todo = [base]
                while todo:
                    for path, is_file, size, mtime in file_entries(system, todo.pop()):
                        if not is_file and path.rpartition("/")[2] in skip:
                            continue
                        when = None if mtime is None else datetime.fromtimestamp(mtime, timezone.utc)
                        rows.append((path[len(start):].lstrip("/"), scheme + path, is_file, size if is_file else None, when))
                        if recursive and not is_file:
                            todo.append(path)
                        if len(rows) >= BATCH_ROWS:
                            yield flush()
        if rows:
            yield flush()

    return run


def list_tree(spark: SparkSession, root: str, spread: int = 2, skip: Sequence[str] = ()) -> DataFrame:
    """Everything below ``root``: path relative to it, uri, is_file, size, modified_at.

    The first ``spread`` levels are listed once, folder by folder, and every folder below
    them is a row of its own, spread over the executors, which go through it as a stream.
    Folders named in ``skip`` are not entered.
    """
    found = None
    level = spark.createDataFrame([(root.rstrip("/"),)], "folder string")
    for _ in range(spread):
        entries = settle(level.mapInPandas(_lister(root, False, skip), ENTRY), "listing")
        found = entries if found is None else found.unionByName(entries)
        level = entries.where(~F.col("is_file")).select(F.col("uri").alias("folder")).repartition("folder")
    return found.unionByName(level.mapInPandas(_lister(root, True, skip), ENTRY))


def read_files(files: DataFrame) -> DataFrame:
    """``files`` (with a column uri) with ``content``, the bytes of each, read in tasks."""
    kept = files.drop("content")
    schema = kept.withColumn("content", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, contents = 0, 0, []
            for i, uri in enumerate(batch.column("uri").to_pylist()):
                system, path, _ = open_store(uri)
                with system.open_input_stream(path, compression=None) as f:
                    contents.append(f.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield batch.slice(start, i + 1 - start).append_column("content", pa.array(contents, pa.binary()))
                    start, held, contents = i + 1, 0, []

    return kept.repartition("uri").mapInArrow(run, schema)


def read_texts(files: DataFrame) -> DataFrame:
    """``files`` with ``text``; bytes that are no UTF-8 become replacement characters."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return read_files(files).withColumn("text", text).drop("content")
