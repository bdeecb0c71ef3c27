"""Incremental feed ingest: a file stream of articles applied to the corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.updates import inbox_of, latest_per_key, merge_targets, sync_tally, update_targets
from ..sinks.corpus import commit_sync_log, only_domains, stage, swap_corpus
from ..sources.articles import articles_of, feed_status, number_pieces, read_corpus, read_sync_log
from ..sources.feed_stream import FILES_PER_BATCH, stream_feed_files

FEED_ORDER = ("feed_file", "feed_pos")
TALLY = T.StructType([
    T.StructField("feed_file", T.StringType()),
    T.StructField("updated", T.LongType()),
    T.StructField("new", T.LongType()),
])


def apply_batch(
    batch: DataFrame, batch_id: int, corpus_path: str, log_path: str, staging: str,
    mode: str = "update_only", new_domain: str | None = None, run_id: str = "run",
) -> None:
    """Apply one batch: tally, last writer wins, swap, then log.

    ``batch`` holds feed rows, or feed pieces (see ``sources.articles``), which
    are parsed here. Safe to repeat: the rows are staged first, so the feed is
    parsed once. The tally is staged before the corpus changes, and a repeated
    batch reads it back instead of counting against the corpus it has already
    changed. Staging and log are kept by run and batch. A row written by a later feed row is never replaced by an earlier one.
    """
    spark = batch.sparkSession
    here = f"{staging.rstrip('/')}/run={run_id}/batch={batch_id}"
    if "value" in batch.columns:
        pieces = batch if "feed_pos" in batch.columns else number_pieces(batch)
        status = stage(feed_status(pieces), f"{here}/status")
        rows = articles_of(pieces, status)
    else:
        rows = batch
        status = None
    feed = stage(rows, f"{here}/feed")
    if status is None:
        status = feed.select("feed_file", F.lit("ok").alias("status")).distinct()
    corpus = read_corpus(spark, corpus_path)
    tally = _staged(spark, f"{here}/tally", TALLY) or stage(sync_tally(feed, corpus), f"{here}/tally")
    inbox = inbox_of(mode, new_domain)
    latest = latest_per_key(feed, ["pmid"], FEED_ORDER)
    targets = stage(update_targets(corpus, latest, new_domain=inbox), f"{here}/targets")
    merged = merge_targets(
        only_domains(corpus, targets), targets, insert=inbox is not None, newer_by=FEED_ORDER)
    swap_corpus(merged.drop("touched"), corpus_path, f"{here}/corpus")
    logged = status.join(tally, "feed_file", "left").select(
        F.col("feed_file").alias("file"), "status", F.coalesce("updated", F.lit(0)).alias("updated"),
        F.coalesce("new", F.lit(0)).alias("new"), F.current_timestamp().alias("synced_at"),
    )
    commit_sync_log(logged, log_path, batch_id, run_id)


def _staged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """What an earlier try of this batch staged, if it got so far."""
    try:
        spark.read.text(f"{path}/_SUCCESS", wholetext=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.schema(schema).parquet(path)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the stream keeps in its checkpoint: a new checkpoint is a new run."""
    found = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True)
    return found.select(F.get_json_object("value", "$.id")).first()[0]


def ingest(
    source: DataFrame, corpus_path: str, log_path: str, staging: str, checkpoint: str,
    mode: str = "update_only", new_domain: str | None = None,
) -> StreamingQuery:
    """Process every feed file not seen yet, then stop. The checkpoint remembers them.

    ``source`` is a stream of feed pieces or of feed rows.
    """
    return _writer(source, corpus_path, log_path, staging, checkpoint, mode, new_domain).trigger(availableNow=True).start()


def _writer(source: DataFrame, corpus_path: str, log_path: str, staging: str, checkpoint: str, mode: str, new_domain: str | None):
    def each(batch: DataFrame, batch_id: int) -> None:
        run_id = _run_id(batch.sparkSession, checkpoint)
        apply_batch(batch, batch_id, corpus_path, log_path, staging, mode, new_domain, run_id)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def ingest_feed(
    spark: SparkSession, feed: str, corpus_path: str, log_path: str, staging: str, checkpoint: str,
    mode: str = "update_only", new_domain: str | None = None, max_files: int = FILES_PER_BATCH,
) -> None:
    """Process the feed files behind the last one processed, ``max_files`` a batch, in the order of their names.

    Where to begin is what the checkpoint says, and before the first run what the log says. Batches follow
    each other until no file is left; a failed one is repeated by the next call.
    """
    source = stream_feed_files(spark, feed, checkpoint, last_logged(spark, log_path), max_files)
    query = _writer(source, corpus_path, log_path, staging, checkpoint, mode, new_domain).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def last_logged(spark: SparkSession, log_path: str) -> str | None:
    """The last file, by name, that the log has."""
    return read_sync_log(spark, log_path).agg(F.max("file")).first()[0]
