"""A writer of feed files: one gzip file of XML per feed file."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.files import open_store

HEAD, FOOT = b"<?xml version=\"1.0\"?>\n<PubmedArticleSet>\n", b"\n</PubmedArticleSet>\n"


def write_feed_files(records: DataFrame, path: str, file_col: str = "feed_file", order_by: str = "feed_pos", value: str = "value") -> int:
    """Write ``value`` (whole records) to ``path``/``file_col``, in the order of ``order_by``; returns the number of files.

    A file is written by one task as its rows pass by, under another name until it is whole, so a
    repeated task leaves the same files.
    """
    top = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = open_store(top)
        system.create_dir(base, recursive=True)
        state: dict = {}
        done: list[str] = []

        def finish() -> None:
            out, gz, hidden, name = (state[k] for k in ("out", "gz", "hidden", "name"))
            out.write(gz.compress(FOOT) + gz.flush())
            out.close()
            system.move(hidden, f"{base}/{name}")
            done.append(name)
            state.clear()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state and state["name"] != name:
                    finish()
                if not state:
                    hidden = f"{base}/.{name}-{uuid.uuid4().hex}"
                    gz = zlib.compressobj(wbits=31)
                    state.update(name=name, hidden=hidden, gz=gz, out=system.open_output_stream(hidden, compression=None))
                    state["out"].write(gz.compress(HEAD))
                state["out"].write(state["gz"].compress((text or "").encode()))
        if state:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    dealt = records.repartition(file_col).sortWithinPartitions(file_col, order_by).select(file_col, value)
    return dealt.mapInArrow(run, "file string").count()
