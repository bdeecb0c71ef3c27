"""Corpus, chunk and sync-log writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.chunks import chunk_rows
from ..sources.files import open_store

#: What a folder's name cannot hold.
_NO_NAME = re.compile(r"[\x00-\x1f/%]|^\.{1,2}$")


def stage(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and survives lost executors."""
    if partition_by:
        df = _balanced(df, partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        # Not the dynamic mode: a replayed batch replaces its own earlier try whole.
        writer = writer.option("partitionOverwriteMode", "static").partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _balanced(df: DataFrame, partition_by: str) -> DataFrame:
    """Rows of a partition together, but with a hint that lets Spark split one that
    holds most of the rows over several tasks and files, and join small ones.
    """
    return df.hint("rebalance", partition_by)


def replace_partitions(
    df: DataFrame, path: str, partition_by: str, balanced: bool = False
) -> None:
    """Replace the partitions that occur in ``df``; the others stay.

    ``balanced`` rows (such as staged ones) are written as they lie, without a shuffle.
    """
    rows = df if balanced else _balanced(df, partition_by)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by).parquet(path)
    )


def only_domains(corpus: DataFrame, targets: DataFrame, domain: str = "domain") -> DataFrame:
    """The corpus cut down to the domains of the targets.

    The names become literals, so the other partitions are not even listed. There
    are at most as many as the table has partitions, or one more.
    """
    names = [r[0] for r in targets.select(domain).distinct().collect()]
    return corpus.where(F.col(domain).isin(names))


def swap_corpus(rows: DataFrame, path: str, staging: str, domain: str = "domain") -> None:
    """Stage the new partitions, then swap them in.

    A failure while staging leaves the corpus as it was; after a failure during
    the swap, call :func:`finish_swap` with the staged folder.
    """
    stage(rows, staging, domain)
    finish_swap(rows.sparkSession, staging, path, domain)


def finish_swap(spark: SparkSession, staging: str, path: str, domain: str = "domain") -> None:
    staged = spark.read.schema(schemas.CORPUS).parquet(staging)
    if staged.isEmpty():
        return
    replace_partitions(staged, path, domain, balanced=True)


def write_json_corpus(articles: DataFrame, path: str, domain: str = "domain") -> int:
    """One JSON file per row, in a folder per ``domain``, as ``read_json_corpus`` reads them; returns the number of files.

    The rows are dealt evenly, whatever their domains, to ``spark.sql.shuffle.partitions`` tasks. A file has
    another name until it is whole, so a repeated task leaves the same files. A null domain's folder has Spark's
    name for null; what a name cannot hold is escaped.
    """
    top = path.rstrip("/")
    folder = F.coalesce(F.col(domain).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    value = F.to_json(F.struct(*[c for c in articles.columns if c != domain]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = open_store(top)
        made: set[str] = set()
        written, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = _NO_NAME.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), name)
                if name not in made:
                    system.create_dir(f"{base}/{name}", recursive=True)
                    made.add(name)
                file = f"part-{task:05d}-{written:08d}.json"
                hidden = f"{base}/{name}/.{file}-{uuid.uuid4().hex}"
                with system.open_output_stream(hidden, compression=None) as out:
                    out.write(text.encode() + b"\n")
                system.move(hidden, f"{base}/{name}/{file}")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    tasks = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = articles.select(folder.alias("folder"), value.alias("value")).repartition(tasks)
    return dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_chunks(chunked: DataFrame, path: str, key: str = "pmid") -> None:
    """One folder per chunk; the rows of a chunk are unique by ``key``."""
    replace_partitions(chunk_rows(chunked, key).drop("idx"), path, "chunk")


def commit_sync_log(rows: DataFrame, path: str, batch_id: int, run_id: str = "run") -> None:
    """Log rows of one batch of one run. Committing the same batch again replaces them.

    A run is what shares a checkpoint; batch 0 of a new one never touches an old one's rows.
    """
    logged = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn(
        "batch", F.lit(f"{run_id}-{batch_id}")).select(*[F.col(f.name).cast(f.dataType) for f in schemas.SYNC_LOG])
    replace_partitions(logged, path, "batch")
