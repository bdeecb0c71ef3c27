"""Long work per chunk: a few chunks at a time, and a rerun does only what has not been finished."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import apply_per_chunk, chunk_status

#: Fixed value: chunks worked on at a time.
AT_ONCE = 2


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; empty before the first try."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_log(spark: SparkSession, home: str, chunk_col: str = "chunk") -> DataFrame:
    """Status of every chunk in every try that came to its end."""
    return _read(spark, f"{home}/status", T.StructType([
        T.StructField(chunk_col, T.StringType()), T.StructField("rows_in", T.LongType()), T.StructField("rows_out", T.LongType()),
        T.StructField("message", T.StringType()), T.StructField("status", T.StringType()), T.StructField("try", T.StringType())]))


def run_chunks(
    chunked: DataFrame, fn: Callable[[str, pd.DataFrame], pd.DataFrame], schema: T.StructType, home: str,
    at_once: int | None = AT_ONCE, chunk_col: str = "chunk", profile=None,
) -> DataFrame:
    """Work on the chunks that ``home`` does not mark as finished; returns this try's status rows.

    Each of ``at_once`` tasks takes one chunk after the other, read in Arrow batches, so a task holds
    a batch, not a chunk; with None the rows stay where they are and all tasks work at once. ``fn`` sees
    a batch of one chunk. A chunk in which it raised is not worked on further in that task and comes
    again with the next call. A try writes a folder of its own, and its markers in one file when it is
    whole: what a broken-off try left is never read. An empty input gives no rows; a null chunk is one
    as well; columns other than ``chunk_col`` go to ``fn`` as they are.
    """
    spark, run = chunked.sparkSession, uuid.uuid4().hex
    done = run_log(spark, home, chunk_col).where("status = 'ok'").select(F.col(chunk_col).alias("_done")).distinct()
    todo = chunked.join(done, chunked[chunk_col].eqNullSafe(done["_done"]), "left_anti")
    if at_once is not None:
        todo = todo.repartition(at_once, chunk_col).sortWithinPartitions(chunk_col)
    applied = apply_per_chunk(todo, fn, schema, chunk_col, profile)
    applied.write.parquet(f"{home}/tries/try={run}")
    stored = spark.read.schema(applied.schema).parquet(f"{home}/tries/try={run}")
    status = chunk_status(stored, chunk_col).drop("failed_batches")
    status.coalesce(1).write.parquet(f"{home}/status/try={run}")
    return run_log(spark, home, chunk_col).where(F.col("try") == run).drop("try")


def finished_rows(spark: SparkSession, home: str, schema: T.StructType, chunk_col: str = "chunk") -> DataFrame:
    """The rows of all finished chunks, each from one try that finished it."""
    won = run_log(spark, home, chunk_col).where("status = 'ok'").groupBy(F.col(chunk_col).alias("_chunk")).agg(F.min("try").alias("_try"))
    stored = T.StructType([
        T.StructField(chunk_col, T.StringType()), T.StructField("error", T.StringType()), *schema.fields, T.StructField("try", T.StringType())])
    rows = _read(spark, f"{home}/tries", stored).where(F.col("error").isNull())
    mine = F.col(chunk_col).eqNullSafe(F.col("_chunk")) & (F.col("try") == F.col("_try"))
    return rows.join(won, mine, "left_semi").select(chunk_col, *schema.names)
