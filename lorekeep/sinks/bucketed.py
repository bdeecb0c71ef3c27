"""A corpus kept in bucketed tables: rows of a key lie in one bucket, sorted.

An update then shuffles the feed alone, to the corpus' buckets; the corpus is read where it
lies. Each state of the corpus is a table of its own, ``<name>_v<number>``, that Spark
registers when all of it is written. The highest number is the corpus, so a failed
update leaves the one before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.updates import apply_updates_colocated, latest_per_key
from ..session import remove

#: Bytes of a bucket that its number follows from, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 512 << 20, 1 << 16


def bucket_count(total_bytes: int, least: int = 1) -> int:
    """Buckets of about ``BUCKET_BYTES``, a power of two, so that tables of two sizes still fit each other."""
    want = max(least, -(-total_bytes // BUCKET_BYTES))
    return min(MOST_BUCKETS, 1 << (want - 1).bit_length())


def versions(spark: SparkSession, name: str) -> list[int]:
    """The states of a corpus that are there, in order."""
    found = (re.fullmatch(rf"{re.escape(name)}_v(\d+)", t.name) for t in spark.catalog.listTables(pattern=f"{name}_v*"))
    return sorted(int(m[1]) for m in found if m)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """The corpus' latest state."""
    found = versions(spark, name)
    if not found:
        raise ValueError(f"there is no corpus {name!r}")
    return spark.table(f"{name}_v{found[-1]}")


def write_bucketed(rows: DataFrame, name: str, buckets: int, key: str = "pmid", in_place: bool = False, path: str | None = None) -> str:
    """Write ``rows`` as the next state; returns its table.

    ``in_place`` rows lie in these buckets already, as an update's do, and are not shuffled again. Others
    are dealt by key first, so a bucket is one file and not one of every task. A key without
    a value goes to the bucket of null. With ``path`` the files go there, not to the warehouse.
    """
    spark = rows.sparkSession
    table = f"{name}_v{max(versions(spark, name), default=0) + 1}"
    dealt = rows if in_place else rows.repartition(buckets, key)
    writer = dealt.write.format("parquet").mode("error").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", f"{path.rstrip('/')}/{table}")
    writer.saveAsTable(table)
    return table


def buckets_of(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"DESCRIBE FORMATTED `{table}`").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"])


def update_bucketed(
    spark: SparkSession, name: str, feed: DataFrame, key: str = "pmid", domain: str = "domain", order_by=("feed_file", "feed_pos"),
    mode: str = "update_only", new_domain: str | None = None, path: str | None = None, keep: int = 1,
) -> str:
    """Apply a feed and write the next state; returns its table. ``keep`` states before it stay.

    Nothing of the corpus is shuffled, neither to find the keys nor to write the result.
    """
    found = versions(spark, name)
    if not found:
        raise ValueError(f"there is no corpus {name!r}")
    now = f"{name}_v{found[-1]}"
    latest = latest_per_key(feed, [key], list(order_by))
    done = apply_updates_colocated(spark.table(now), latest, key, domain, mode, new_domain, newer_by=order_by).drop("touched")
    table = write_bucketed(done, name, buckets_of(spark, now), key, in_place=mode == "update_only", path=path)
    for old in found[:len(found) - keep]:
        drop_version(spark, name, old)
    return table


def drop_version(spark: SparkSession, name: str, version: int) -> None:
    """Drop a state with its files, in the warehouse or not."""
    table = f"{name}_v{version}"
    where = spark.sql(f"DESCRIBE FORMATTED `{table}`").where(F.col("col_name") == "Location").first()["data_type"]
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    remove(spark, where)
