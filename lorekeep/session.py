"""Session settings and the shared work folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "lorekeep", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """This application's own folder in the shared store.

    It lies in ``spark.checkpoint.dir``, else below ``spark.sql.warehouse.dir``;
    the driver and all executors reach both.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lorekeep-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``work_root``."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession) -> set[str]:
    """The folders below ``work_root`` that are there now."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in store.listStatus(root)} if store.exists(root) else set()


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Remove everything this application has settled.

    To be called when the results that read the settled tables have been written.
    """
    remove(spark, work_root(spark))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result of joins that several jobs go on with: they read the table
    instead of doing the joins again, and it is still there when executors go.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
