"""Fixed-size chunks: assignment, the next number, the check, and work per chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import chunk_name, chunk_number
from .ordering import ROWS_PER_RANGE, dense_index
from .updates import changed_since, latest_per_key

# Records of a chunk, and the number of the first one.
CHUNK_SIZE = 500_000
FIRST_CHUNK = 57


def assign_chunks(
    df: DataFrame,
    order_by: Sequence[str],
    prefix: str,
    size: int = CHUNK_SIZE,
    start: int = FIRST_CHUNK,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``idx`` and ``chunk``: the i-th row goes to chunk ``start + i div size``."""
    numbered = dense_index(df, order_by, "idx", rows_per_range=rows_per_range)
    number = F.lit(start) + F.floor(F.col("idx") / F.lit(size))
    return numbered.withColumn("chunk", chunk_name(number, prefix))


def chunk_rows(chunked: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows to write: inside a chunk the later of two rows with one key wins."""
    return latest_per_key(chunked, ["chunk", key], ["idx"])


def next_chunk(
    names: DataFrame, prefix: str, name_col: str = "name", group_by: Sequence[str] = (),
    default: int = FIRST_CHUNK,
) -> DataFrame:
    """Highest number in use plus one; ``default`` if no name holds a number."""
    number = F.coalesce(
        F.max(chunk_number(F.col(name_col), prefix)) + 1, F.lit(default).cast("bigint")
    )
    out = names.groupBy(*group_by).agg(number.alias("next_no"))
    return out.withColumn("next_name", chunk_name(F.col("next_no"), prefix))


def chunk_changes(
    corpus: DataFrame, cutoff, prefix: str, size: int = CHUNK_SIZE, changed_at: str = "last_updated",
    order_by: Sequence[str] = ("pmid", "domain"), rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """New chunks from the articles changed after ``cutoff``.

    Numbering goes on after the chunks that lie next to the domains; these are not
    chunked again. Articles without an id are left out.
    """
    domains = corpus.select(F.col("domain").alias("name")).distinct()
    in_chunks = F.startswith(F.col("name"), F.lit(prefix))
    start = next_chunk(domains.where(in_chunks), prefix).first()["next_no"]
    changed = changed_since(corpus, changed_at, cutoff).where(
        ~F.startswith(F.col("domain"), F.lit(prefix)) & F.col("pmid").isNotNull())
    return assign_chunks(changed, order_by, prefix, size, start, rows_per_range)


def check_chunks(source: DataFrame, chunked: DataFrame, key: str, size: int) -> DataFrame:
    """One row: counts on both sides, what was left behind, what came twice, verdict."""
    src = source.groupBy(key).agg(F.count(F.lit(1)).alias("_src"))
    dst = chunked.groupBy(key).agg(F.count(F.lit(1)).alias("_dst"))
    both = src.join(dst, key, "full").agg(
        F.coalesce(F.sum("_src"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("_dst"), F.lit(0)).alias("chunked_rows"),
        F.count_if(F.col("_dst").isNull()).alias("left_behind"),
        F.count_if(F.col("_dst") > 1).alias("repeated"),
    )
    sizes = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.struct(
            F.count(F.lit(1)).alias("chunks"),
            F.count_if(F.col("_n") < size).alias("short_chunks"),
            F.count_if(F.col("_n") > size).alias("long_chunks"),
        ).alias("sizes")
    )
    row = both.select("*", sizes.scalar().alias("_sizes")).select(*both.columns, "_sizes.*")
    whole = (
        (F.col("source_rows") == F.col("chunked_rows")) & (F.col("left_behind") == 0)
        & (F.col("long_chunks") == 0) & (F.col("short_chunks") <= 1)
    )
    return row.withColumn("verdict", F.when(whole, "PASS").otherwise("FAIL"))


def apply_per_chunk(
    chunked: DataFrame,
    fn: Callable[[str, pd.DataFrame], pd.DataFrame],
    schema: T.StructType,
    chunk_col: str = "chunk",
    profile=None,
) -> DataFrame:
    """Run ``fn(chunk, batch)`` over every chunk, one Arrow batch at a time.

    ``fn`` sees the rows of one chunk only, never a whole chunk at once. No shuffle
    is needed: rows are taken where they are. A batch on which ``fn`` raises gives
    one row with the text in ``error``, as do that chunk's later batches in the task without
    being tried, and the other chunks go on. How many run
    at once follows from the executors; pass a resource ``profile`` to hold more
    cores or memory per task.

    Output: ``chunk``, ``rows_in`` (on the first row of each batch, so it sums to
    the input), ``error``, then the columns of ``schema``.
    """
    names = [f.name for f in schema.fields]
    out_schema = T.StructType(
        [T.StructField(chunk_col, T.StringType()), T.StructField("rows_in", T.LongType()),
         T.StructField("error", T.StringType()), *schema.fields]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed: dict[str, str] = {}
        for batch in batches:
            for chunk, rows in batch.groupby(chunk_col, sort=False, dropna=False):
                rows = rows.reset_index(drop=True)
                chunk = None if pd.isna(chunk) else chunk
                error = failed.get(chunk)
                if error is None:
                    try:
                        result = fn(chunk, rows).reset_index(drop=True)[names]
                    except Exception as exc:  # the failure is the chunk's status row
                        error = failed[chunk] = f"{type(exc).__name__}: {exc}"
                if error is not None:
                    result = pd.DataFrame({n: [None] for n in names})
                if result.empty:
                    result = pd.DataFrame({n: [None] for n in names})
                    error = ""
                result.insert(0, "error", error)
                result.insert(0, "rows_in", [len(rows)] + [0] * (len(result) - 1))
                result.insert(0, chunk_col, chunk)
                yield result

    return chunked.mapInPandas(run, out_schema, profile=profile)


def chunk_status(applied: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """One row per chunk: rows read and produced, failed batches, ok or failed."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return applied.groupBy(chunk_col).agg(
        F.sum("rows_in").alias("rows_in"),
        F.count_if(F.col("error").isNull()).alias("rows_out"),
        F.count_if(failed).alias("failed_batches"),
        F.max(F.when(failed, F.col("error"))).alias("message"),
        F.when(F.count_if(failed) > 0, "failed").otherwise("ok").alias("status"),
    )


def chunk_results(applied: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """The rows that ``fn`` produced for chunks without a failure; a chunk is whole or not there."""
    failed = applied.where(F.col("error") != "").select(chunk_col).distinct()
    good = applied.where(F.col("error").isNull()).drop("error", "rows_in")
    return good.join(failed, chunk_col, "left_anti").select(good.columns)
