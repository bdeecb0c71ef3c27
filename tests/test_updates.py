import pytest
from pyspark.sql import functions as F

from lorekeep.operators import chunk_runs, chunks, studies, updates
from lorekeep.sinks.corpus import write_chunks

CORPUS = [("b", "1", "old", None, None), ("a", "1", "old", None, None), ("a", "2", "old", "u9", 5), ("c", "3", "old", None, None)]
FEED = [("u1", 1, "1", "x1"), ("u2", 1, "1", "x2"), ("u2", 2, "1", "x3"), ("u1", 2, "2", "y"), ("u1", 3, "8", "z"),
        ("u1", 4, "8", "z2"), ("u1", 5, None, "n")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(CORPUS, "domain string, pmid string, body string, feed_file string, feed_pos long")


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(FEED, "feed_file string, feed_pos long, pmid string, body string")


def test_pending(spark, rows):
    listing = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], "file string")
    done = spark.createDataFrame([("u3",)], "file string")
    assert rows(updates.pending_files(listing, done)) == [("u1",), ("u2",), ("u4",)]
    assert rows(updates.pending_files(listing, done, last_file="u2")) == [("u4",)]
    assert rows(updates.pending_files(listing.limit(0), done)) == []


def test_last_writer_wins(feed, rows):
    latest = updates.latest_per_key(feed, ["pmid"], ["feed_file", "feed_pos"])
    assert rows(latest) == [("u1", 2, "2", "y"), ("u1", 4, "8", "z2"), ("u2", 2, "1", "x3")]


def test_tally_counts_rows(feed, corpus, rows):
    tally = updates.sync_tally(feed.dropna(), corpus)
    assert rows(tally) == [("u1", 2, 2), ("u2", 2, 0)]
    totals = updates.running_totals(tally, seed_updated=10, seed_new=20)
    assert rows(totals) == [("u1", 2, 2, 12, 22), ("u2", 2, 0, 14, 22)]
    assert tally.agg(F.sum(F.col("updated") + F.col("new"))).first()[0] == feed.dropna().count()


def latest(feed):
    return updates.latest_per_key(feed, ["pmid"], ["feed_file", "feed_pos"])


def test_update_goes_to_the_first_domain_only(feed, corpus, rows):
    out = updates.apply_updates(corpus, latest(feed)).select("domain", "pmid", "body", "touched")
    assert rows(out) == [("a", "1", "x3", True), ("a", "2", "y", True), ("b", "1", "old", False), ("c", "3", "old", False)]


def test_newer_row_stays(feed, corpus, rows):
    out = updates.apply_updates(corpus, latest(feed), newer_by=("feed_file", "feed_pos"))
    assert rows(out.select("domain", "pmid", "body").where("pmid = '2'")) == [("a", "2", "old")]


def test_upsert_adds_unknown(feed, corpus, rows):
    out = updates.apply_updates(corpus, latest(feed), mode="upsert", new_domain="new")
    assert rows(out.where("domain = 'new'").select("pmid", "body", "touched")) == [("8", "z2", True)]
    with pytest.raises(ValueError):
        updates.apply_updates(corpus, latest(feed), mode="upsert")


def test_applying_twice_changes_nothing(feed, corpus, rows):
    once = updates.apply_updates(corpus, latest(feed)).drop("touched")
    twice = updates.apply_updates(once, latest(feed)).drop("touched")
    assert rows(once) == rows(twice)


@pytest.mark.parametrize("n, sizes", [(0, []), (4, [4]), (5, [5]), (6, [5, 1]), (20, [5, 5, 5, 5])])
def test_chunk_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").cast("string").alias("pmid"))
    out = chunks.assign_chunks(df, ["pmid"], "c", 5, rows_per_range=3)
    got = [r["count"] for r in out.groupBy("chunk").count().orderBy("chunk").collect()]
    assert got == sizes
    names = [r.chunk for r in out.select("chunk").distinct().orderBy("chunk").collect()]
    assert names == [f"c{57 + i:03d}" for i in range(len(sizes))]
    verdict = chunks.check_chunks(df, out, "pmid", 5).first()
    assert verdict.verdict == "PASS" and verdict.source_rows == n and verdict.left_behind == 0


def test_check_sees_losses_and_repeats(spark):
    src = spark.range(10).select(F.col("id").alias("pmid"))
    out = chunks.assign_chunks(src, ["pmid"], "c", 5)
    lost = chunks.check_chunks(src, out.where("pmid <> 3"), "pmid", 5).first()
    assert (lost.verdict, lost.left_behind) == ("FAIL", 1)
    twice = chunks.check_chunks(src, out.union(out.where("pmid = 3")), "pmid", 5).first()
    assert (twice.verdict, twice.repeated, twice.long_chunks) == ("FAIL", 1, 1)


def test_next_chunk(spark):
    def after(*names):
        return chunks.next_chunk(spark.createDataFrame([(n,) for n in names], "name string"), "c").first()

    assert tuple(after("c057", "c101", "cabc")) == (102, "c102")
    assert tuple(after("cabc")) == (57, "c057")
    assert tuple(chunks.next_chunk(spark.createDataFrame([], "name string"), "c").first()) == (57, "c057")


def test_write_chunks_keeps_the_later_of_two(spark, tmp_path, rows):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 3)], "pmid string, body string, n int")
    out = chunks.assign_chunks(df, ["n"], "c", 5)
    write_chunks(out.drop("n"), str(tmp_path / "chunks"))
    assert rows(spark.read.parquet(str(tmp_path / "chunks")).select("pmid", "body")) == [("1", "b"), ("2", "c")]


def test_apply_per_chunk_reports_failures(spark, rows):
    from pyspark.sql import types as T

    def fn(chunk, pdf):
        if chunk == "c1":
            raise RuntimeError("boom")
        return pdf[["id"]].assign(id=pdf["id"] * 2) if chunk == "c0" else pdf[["id"]].head(0)

    df = spark.range(30).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("chunk"))
    applied = chunks.apply_per_chunk(df, fn, T.StructType([T.StructField("id", T.LongType())]))
    assert rows(chunks.chunk_results(applied)) == sorted([("c0", 2 * i) for i in range(0, 30, 3)], key=repr)
    got = {r.chunk: (r.rows_in, r.rows_out, r.status) for r in chunks.chunk_status(applied).collect()}
    assert got == {"c0": (10, 10, "ok"), "c1": (10, 0, "failed"), "c2": (10, 0, "ok")}


def test_chunk_runs_do_only_what_is_not_finished(spark, rows, tmp_path):
    from pyspark.sql import types as T

    home, schema = str(tmp_path / "home"), T.StructType([T.StructField("id", T.LongType())])
    seen = tmp_path / "seen"
    seen.mkdir()

    def work(name, refuse):
        def fn(chunk, pdf):
            with open(f"{seen}/{name}-{chunk}", "a") as f:
                f.write("x")
            if chunk in refuse:
                raise RuntimeError("boom")
            return pdf[["id"]] * 2
        return fn

    def calls(name):
        return {p.name.split("-")[1]: len(p.read_text()) for p in seen.iterdir() if p.name.startswith(name)}

    df = spark.range(40).select(
        "id", F.when(F.col("id") % 4 < 3, F.concat(F.lit("c"), F.col("id") % 4)).alias("chunk"), F.lit(1).alias("error"), F.lit(2).alias("_done"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        first = chunk_runs.run_chunks(df, work("a", ("c1",)), schema, home)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(first.select("chunk", "rows_in", "status")) == sorted([("c0", 10, "ok"), ("c1", 10, "failed"), ("c2", 10, "ok"), (None, 10, "ok")], key=repr)
    assert calls("a")["c1"] == 1 and calls("a")["c0"] > 1  # a failed chunk is not worked on further
    want = sorted([(None if i % 4 == 3 else f"c{i % 4}", 2 * i) for i in range(40)], key=repr)
    assert rows(chunk_runs.finished_rows(spark, home, schema)) == [r for r in want if r[0] != "c1"]
    # A try that broke off has left rows but no markers.
    spark.createDataFrame([("c1", 1, None, 99)], "chunk string, rows_in long, error string, id long").write.parquet(f"{home}/tries/try=0")
    assert rows(chunk_runs.run_chunks(df, work("b", ()), schema, home).select("chunk", "status")) == [("c1", "ok")]
    assert set(calls("b")) == {"c1"} and rows(chunk_runs.finished_rows(spark, home, schema)) == want
    assert chunk_runs.run_chunks(df, work("c", ()), schema, home, at_once=None).count() == 0 and not calls("c")
    assert rows(chunk_runs.finished_rows(spark, home, schema)) == want
    assert chunk_runs.run_chunks(df.limit(0), work("d", ()), schema, str(tmp_path / "none")).count() == 0


def test_changed_since_is_strict(spark):
    df = spark.createDataFrame([("2026-06-01 00:00:00",), ("2026-06-01 00:00:01",)], "t string").select(
        F.col("t").cast("timestamp").alias("t"))
    assert updates.changed_since(df, "t", "2026-06-01 00:00:00").count() == 1


def test_studies(spark, rows):
    docs = spark.createDataFrame(
        [(1, "Gene EDITING with CRISPR Cas9, therapeutic"), (2, "gene editing crispr cas9"), (3, "therapeutic crispr cas9 gene editing PD-1")],
        "doc int, text string")
    terms = {"s": studies.split_search("CRISPR Cas9 AND gene editing AND therapeutic"), "p": ["pd-1"], "none": ["zzz"]}
    assert rows(studies.select_studies(docs, terms, "doc")) == [("p", 3, 1), ("s", 1, 1), ("s", 3, 2)]
    assert rows(studies.select_studies(docs, terms, "doc", retmax=1)) == [("p", 3, 1), ("s", 1, 1)]
    assert len(studies.STUDIES) == 5


def test_chunks_from_changes(spark, rows):
    df = spark.createDataFrame(
        [("d", "1", "2026-06-02"), ("d", "2", "2026-05-01"), ("e", "1", "2026-06-03"), ("c060", "9", "2026-06-09"), ("d", None, "2026-06-09"),
         ("cx", "8", "2026-06-09")],
        "domain string, pmid string, t string").withColumn("last_updated", F.col("t").cast("timestamp"))
    out = chunks.chunk_changes(df, "2026-06-01 00:00:00", "c", size=1)
    assert rows(out.select("domain", "pmid", "chunk")) == [("d", "1", "c061"), ("e", "1", "c062")]


def test_work_dir_is_in_the_shared_folder(spark):
    from lorekeep.session import work_dir

    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first.startswith(shared) and first != second


def test_a_failed_chunk_gives_no_rows(spark, rows):
    applied = spark.createDataFrame(
        [("a", 2, None, 1), ("a", 2, "RuntimeError: x", None), ("b", 1, None, 7), ("c", 1, "", None)],
        "chunk string, rows_in long, error string, id long")
    assert rows(chunks.chunk_results(applied)) == [("b", 7)]
