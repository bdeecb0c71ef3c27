"""The two streaming jobs, run over the events table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import xml_escape
from ..session import work_dir
from ..sinks.corpus import stage
from ..sinks.feed import write_feed_files
from ..sources.articles import list_feed, read_sync_log
from ..streaming.ingest import ingest, ingest_feed
from ..streaming.run_tracker import run_until_quiet, track_live_runs, track_runs, with_rocksdb
from . import views
from .registry import query
from .rollup_queries import BUDGET_SECONDS, LIVE_OUTCOME_SQL, OUTCOME_SQL
from .views import with_views


def event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("s1_feed_ingest", with_views("v_feed", "v_corpus", "v_latest", "v_applied") + """
    SELECT domain, CAST(pmid AS VARCHAR) AS pmid, body AS abstract, touched FROM v_applied""")
def feed_ingest(t):
    home = work_dir(t.spark, "ingest")
    rows = _start_corpus(t, home)
    feed = views.feed_columns(event_stream(t)).select(
        F.col("fname").alias("feed_file"), F.col("pos").alias("feed_pos"),
        F.col("pmid").cast("string").alias("pmid"), F.lit(None).cast("string").alias("title"),
        F.col("body").alias("abstract"), F.lit("").alias("year"),
        F.array().cast("array<string>").alias("mesh_terms"), F.current_timestamp().alias("last_updated"))
    ingest(feed, f"{home}/corpus", f"{home}/log", f"{home}/staging", f"{home}/checkpoint").awaitTermination()
    return _stored(t, home, rows.schema)


def _start_corpus(t, home):
    rows = views.corpus(t).select(
        F.col("pmid").cast("string").alias("pmid"), F.lit(None).cast("string").alias("title"),
        F.col("body").alias("abstract"), F.lit("").alias("year"),
        F.array().cast("array<string>").alias("mesh_terms"),
        F.lit(None).cast("timestamp").alias("last_updated"),
        F.lit(None).cast("string").alias("feed_file"), F.lit(None).cast("bigint").alias("feed_pos"), "domain")
    return stage(rows, f"{home}/corpus", "domain")


def _stored(t, home, schema):
    stored = t.spark.read.schema(schema).parquet(f"{home}/corpus")
    return stored.select("domain", "pmid", "abstract", F.col("feed_file").isNotNull().alias("touched"))


def _land(t, home, part):
    """Events as gzip files of XML records, one a day; the first half of the month, then the second."""
    record = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("pmid").cast("string"), F.lit("</PMID><Article><Abstract><AbstractText>"),
        xml_escape(F.col("body")), F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>\n"))
    rows = views.feed(t).where((F.substring("fname", 10, 2).cast("int") >= 16).cast("int") == part)
    write_feed_files(rows.select(F.col("fname").alias("feed_file"), F.col("pos").alias("feed_pos"), record.alias("value")), f"{home}/feed")


def _ingested(t):
    """The feed landed and ingested in two runs, and a third one that finds nothing."""
    home = work_dir(t.spark, "feed")
    schema = _start_corpus(t, home).schema
    for part in (0, 1, None):
        if part is not None:
            _land(t, home, part)
        ingest_feed(t.spark, f"{home}/feed", f"{home}/corpus", f"{home}/log", f"{home}/staging", f"{home}/checkpoint")
    return home, schema


@query("s3_feed_files", with_views("v_feed", "v_corpus", "v_latest", "v_applied") + """
    SELECT domain, CAST(pmid AS VARCHAR) AS pmid, body AS abstract, touched FROM v_applied""")
def feed_files(t):
    return _stored(t, *_ingested(t))


@query("s3b_feed_log", with_views("v_feed", "v_corpus") + """
    SELECT fname AS file, 'ok' AS status, true AS listed, count(*) FILTER (pmid IN (SELECT pmid FROM v_corpus)) AS updated,
           count(*) FILTER (pmid NOT IN (SELECT pmid FROM v_corpus)) AS new FROM v_feed GROUP BY fname""")
def feed_log(t):
    home, _ = _ingested(t)
    listed = list_feed(t.spark, f"{home}/feed").select("file", (F.col("size") > 0).alias("listed"))
    return listed.join(read_sync_log(t.spark, f"{home}/log"), "file", "full").select("file", "status", "listed", "updated", "new")


@query("s2_run_tracker", OUTCOME_SQL)
def run_tracker(t):
    home = work_dir(t.spark, "tracker")
    tracked = track_runs(views.run_columns(event_stream(t)), BUDGET_SECONDS)
    job = (
        tracked.writeStream.format("parquet").option("path", f"{home}/out")
        .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return t.spark.read.schema(tracked.schema).parquet(f"{home}/out")


@query("s2b_live_runs", LIVE_OUTCOME_SQL)
def live_runs(t):
    """The days of the table are over, so every run has ended or is past its deadline; timers find those."""
    home = work_dir(t.spark, "live")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    with_rocksdb(t.spark)
    try:
        tracked = track_live_runs(views.run_columns(event_stream(t)), BUDGET_SECONDS)
        run_until_quiet(
            tracked.writeStream.format("parquet").option("path", f"{home}/out")
            .option("checkpointLocation", f"{home}/checkpoint").start())
    finally:
        t.spark.conf.set(provider, before)
    return t.spark.read.schema(tracked.schema).parquet(f"{home}/out")
