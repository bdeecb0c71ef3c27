import gzip
import json
import time
from datetime import datetime, timedelta, timezone

import pytest

from lorekeep import schemas
from lorekeep.operators import runs, updates
from lorekeep.sinks.corpus import finish_swap, stage
from lorekeep.sources import articles, reports
from lorekeep.streaming.ingest import apply_batch, ingest
from lorekeep.streaming.run_tracker import run_until_quiet, track_live_runs, track_runs, with_rocksdb
from tests.test_articles import feed, record


def start_corpus(spark, path):
    rows = [("1", "old", "a"), ("1", "old", "b"), ("2", "old", "b"), ("3", "old", "c")]
    df = spark.createDataFrame(
        [(p, None, t, "", [], None, None, None, d) for p, t, d in rows], schemas.CORPUS)
    stage(df, path, "domain")


def stored(spark, path, rows):
    return rows(spark.read.schema(schemas.CORPUS).parquet(path).select("domain", "pmid", "abstract"))


def drop(folder, name, *records):
    with gzip.open(folder / name, "wb") as f:
        f.write(feed(*records))


def test_feed_ingest_step_by_step(spark, tmp_path, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    home = {k: str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")}
    start_corpus(spark, home["corpus"])
    untouched = sorted(p.name for p in (tmp_path / "corpus" / "domain=c").iterdir() if p.suffix == ".parquet")

    def run():
        ingest(articles.stream_feed_pieces(spark, str(inbox)), home["corpus"], home["log"], home["staging"],
               home["checkpoint"]).awaitTermination()

    drop(inbox, "u1.xml.gz", record("1", abstracts=("v1",)), record("1", abstracts=("v2",)), record("9"), record("2", abstracts=("w",)))
    run()
    want = [("a", "1", "v2"), ("b", "1", "old"), ("b", "2", "w"), ("c", "3", "old")]
    assert stored(spark, home["corpus"], rows) == want
    log = articles.read_sync_log(spark, home["log"])
    assert rows(log.select("file", "status", "updated", "new")) == [("u1.xml.gz", "ok", 3, 1)]
    # Domain c was not touched, so its files are the same ones.
    assert untouched == sorted(p.name for p in (tmp_path / "corpus" / "domain=c").iterdir() if p.suffix == ".parquet")

    run()  # nothing new: nothing changes
    assert stored(spark, home["corpus"], rows) == want
    # A file with an older name arrives late: it must not undo u1.
    drop(inbox, "u0.xml.gz", record("1", abstracts=("stale",)), record("3", abstracts=("fresh",)))
    run()
    assert stored(spark, home["corpus"], rows) == [("a", "1", "v2"), ("b", "1", "old"), ("b", "2", "w"), ("c", "3", "fresh")]
    state = articles.sync_state(articles.read_sync_log(spark, home["log"])).first()
    assert (state.last_file, state.total_updated, state.total_new, state.files_processed) == ("u1.xml.gz", 5, 1, 2)
    assert state.files == ["u0.xml.gz", "u1.xml.gz"]


def test_new_checkpoint_keeps_the_old_log(spark, tmp_path, rows):
    home = {k: str(tmp_path / k) for k in ("corpus", "log", "staging")}
    start_corpus(spark, home["corpus"])
    for name, hits in (("u1", ("1", "9")), ("u2", ("1", "2", "3"))):
        inbox = tmp_path / name
        inbox.mkdir()
        drop(inbox, f"{name}.xml.gz", *[record(h, abstracts=("x",)) for h in hits])
        ingest(articles.stream_feed_pieces(spark, str(inbox)), home["corpus"], home["log"], home["staging"],
               str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    log = articles.read_sync_log(spark, home["log"]).select("file", "status", "new")
    assert rows(log) == [("u1.xml.gz", "ok", 1), ("u2.xml.gz", "ok", 0)]


def test_replayed_batch_gives_the_same(spark, tmp_path, rows):
    home = {k: str(tmp_path / k) for k in ("corpus", "log", "staging")}
    start_corpus(spark, home["corpus"])
    batch = spark.createDataFrame(
        [("u1", 1, "1", None, "v", "", [], None), ("u1", 2, "8", None, "n", "", [], None)], schemas.FEED_ROW)
    for _ in range(2):
        apply_batch(batch, 0, home["corpus"], home["log"], home["staging"], mode="upsert", new_domain="inbox")
        assert stored(spark, home["corpus"], rows) == [
            ("a", "1", "v"), ("b", "1", "old"), ("b", "2", "old"), ("c", "3", "old"), ("inbox", "8", "n")]
        assert rows(articles.read_sync_log(spark, home["log"]).select("file", "updated", "new")) == [("u1", 1, 1)]


def test_broken_off_file_is_logged(spark, tmp_path, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    home = {k: str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")}
    start_corpus(spark, home["corpus"])
    drop(inbox, "u1.xml.gz", record("1", abstracts=("v",)))
    drop(inbox, "u2.xml.gz", *[record(str(i), abstracts=(f"lost {i} " * 30,)) for i in range(300)])
    whole = (inbox / "u2.xml.gz").read_bytes()
    (inbox / "u2.xml.gz").write_bytes(whole[: len(whole) * 2 // 3])
    drop(inbox, "u3.xml.gz", record("7", abstracts=()))
    ingest(articles.stream_feed_pieces(spark, str(inbox)), home["corpus"], home["log"], home["staging"],
           home["checkpoint"]).awaitTermination()
    assert rows(articles.read_sync_log(spark, home["log"]).select("file", "status", "updated", "new")) == [
        ("u1.xml.gz", "ok", 1, 0), ("u2.xml.gz", "corrupt", 0, 0), ("u3.xml.gz", "ok", 0, 0)]
    assert stored(spark, home["corpus"], rows)[0] == ("a", "1", "v") and len(stored(spark, home["corpus"], rows)) == 4


def test_swap_can_be_finished_later(spark, tmp_path, rows):
    home, staged = str(tmp_path / "corpus"), str(tmp_path / "staged")
    start_corpus(spark, home)
    new = spark.createDataFrame([("1", None, "new", "", [], None, "u1", 1, "a")], schemas.CORPUS)
    stage(new, staged, "domain")  # and here the job ends
    assert stored(spark, home, rows)[0] == ("a", "1", "old")
    for _ in range(2):
        finish_swap(spark, staged, home)
        assert stored(spark, home, rows) == [("a", "1", "new"), ("b", "1", "old"), ("b", "2", "old"), ("c", "3", "old")]


def test_stream_equals_batch(spark, tmp_path, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    home = {k: str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")}
    start_corpus(spark, home["corpus"])
    for i in range(3):
        drop(inbox, f"u{i}.xml.gz", *[record(str(k), abstracts=(f"{i}-{k}",)) for k in range(i, 4)])
    feed_rows = articles.read_articles(spark, str(inbox))
    corpus = articles.read_corpus(spark, home["corpus"])
    latest = updates.latest_per_key(feed_rows, ["pmid"], ["feed_file", "feed_pos"])
    want = rows(updates.apply_updates(corpus, latest).select("domain", "pmid", "abstract"))
    stream = articles.stream_feed_pieces(spark, str(inbox), maxFilesPerTrigger=1)
    ingest(stream, home["corpus"], home["log"], home["staging"], home["checkpoint"]).awaitTermination()
    assert stored(spark, home["corpus"], rows) == want


def at(second):
    return f"2026-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def land(folder, name, *snapshots):
    (folder / name).write_text("\n".join(
        json.dumps({"run_id": r, "state": s, "observed_at": at(t)}) for r, s, t in snapshots))


def test_run_tracker(spark, tmp_path, rows):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def run():
        out = track_runs(reports.read_snapshots(spark, str(inbox), streaming=True), 120)
        query = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        return rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select("run_id", "outcome"))

    land(inbox, "1.json", ("a", "running", 0), ("a", "completed", 50), ("b", None, 10), ("c", "running", 10), ("d", "running", 20))
    assert run() == [("a", "COMPLETED")]
    land(inbox, "2.json", ("b", "failed", 60), ("a", "failed", 70), ("e", "running", 100), ("d", "running", 90))
    assert run() == [("a", "COMPLETED"), ("b", "FAILED")]
    land(inbox, "3.json", ("f", "running", 400), ("d", "completed", 399))
    got = run()
    assert got == [("a", "COMPLETED"), ("b", "FAILED"), ("c", "TIMED_OUT"), ("d", "TIMED_OUT"), ("e", "TIMED_OUT")]
    land(inbox, "4.json", ("f", "completed", 500), ("c", "completed", 450))
    assert run() == got + [("f", "COMPLETED")]
    batch = runs.run_outcomes(reports.read_snapshots(spark, str(inbox)), 120).select("run_id", "outcome")
    assert rows(batch) == got + [("f", "COMPLETED")]


@pytest.fixture
def rocksdb(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    with_rocksdb(spark)
    yield
    spark.conf.set(provider, before)


def ago(seconds):
    return (datetime.now(timezone.utc) - timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def test_quiet_runs_time_out_also_after_a_restart(spark, tmp_path, rows, rocksdb):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def send(name, *snapshots):
        (inbox / name).write_text("\n".join(json.dumps({"run_id": r, "state": s, "observed_at": ago(t)}) for r, s, t in snapshots))

    def start():
        out = track_live_runs(reports.read_snapshots(spark, str(inbox), streaming=True), 100, grace_seconds=1)
        return out, (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                     .option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start())

    def found(out):
        return rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select("run_id", "outcome"))

    send("1.json", ("done", "running", 90), ("done", "completed", 50), ("late", "running", 300), ("late", "failed", 10),
         ("quiet", "running", 85), ("open", None, 5), (None, "running", 5))
    out, job = start()
    run_until_quiet(job)
    assert found(out) == [("done", "COMPLETED"), ("late", "TIMED_OUT")]
    # A new start with the old checkpoint; only a snapshot of a closed run comes, and the timer of the quiet one fires.
    send("2.json", ("done", "failed", 1))
    out, job = start()
    try:
        until = time.time() + 60
        while len(found(out)) < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        job.stop()
    assert found(out) == [("done", "COMPLETED"), ("late", "TIMED_OUT"), ("quiet", "TIMED_OUT")]
    times = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("run_id = 'quiet'").first()
    assert times.ended_at - times.started_at == timedelta(seconds=100)
    # The terminal state comes before the timer of the open run.
    send("3.json", ("open", "failed", 0), ("open", "completed", 1))
    out, job = start()
    run_until_quiet(job)
    assert found(out) == [("done", "COMPLETED"), ("late", "TIMED_OUT"), ("open", "COMPLETED"), ("quiet", "TIMED_OUT")]
