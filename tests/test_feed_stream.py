import gzip
import io

import pytest
from pyspark.sql import functions as F

from lorekeep.sinks.feed import write_feed_files
from lorekeep.sources import articles
from lorekeep.sources.feed_stream import FeedStreamReader, last_offset, load_feed_pieces, pieces_of, stream_feed_files
from lorekeep.sources.files import open_store
from lorekeep.streaming.ingest import ingest_feed
from tests.test_articles import feed, record
from tests.test_streaming import drop, start_corpus, stored


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    return folder


def test_pieces_are_those_of_the_text_reader(spark, inbox, rows):
    drop(inbox, "u1.xml.gz", *[record(str(i), abstracts=(f"é {i} " * (i % 40),)) for i in range(500)])
    (inbox / "u2.xml.gz").write_bytes(gzip.compress(feed(record("1", abstracts=("a",)))) + gzip.compress(feed(record("2", abstracts=("b",)))))
    loose = feed(record("5", abstracts=("c",)), record("6", abstracts=("d",))).replace(b"</PubmedArticle>", b"</PubmedArticle \n>", 1)
    (inbox / "u3.xml.gz").write_bytes(gzip.compress(loose))
    drop(inbox, "other.txt")
    got = load_feed_pieces(spark, str(inbox))
    want = articles.read_feed_pieces(spark, str(inbox))
    assert rows(got.select("feed_file", "value")) == rows(want.select("feed_file", "value"))
    assert rows(articles.parse_articles(got).drop("feed_pos")) == rows(articles.parse_articles(want).drop("feed_pos"))
    by_file = got.groupBy("feed_file").agg(F.count_distinct("feed_pos").alias("n"), F.max("feed_pos").alias("m"), F.count("*").alias("c")).collect()
    assert all(r.n == r.c == r.m + 1 for r in by_file)


def test_blocks_may_cut_an_end_tag_anywhere(monkeypatch):
    data = gzip.compress(b"a</PubmedArticle>bb</PubmedArticle >c</PubmedArticle></PubmedArticleSet>")
    for size in range(1, 60):
        monkeypatch.setattr("lorekeep.sources.feed_stream.READ_BYTES", size)
        assert list(pieces_of(io.BytesIO(data))) == ["a", "bb", "c", "</PubmedArticleSet>"]


def test_broken_files_are_logged(spark, inbox, tmp_path, rows):
    home = [str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")]
    start_corpus(spark, home[0])
    drop(inbox, "u1.xml.gz", record("1", abstracts=("v",)))
    whole = gzip.compress(feed(*[record(str(i), abstracts=(f"lost {i} " * 30,)) for i in range(300)]))
    (inbox / "u2.xml.gz").write_bytes(whole[:len(whole) * 2 // 3])
    (inbox / "u3.xml.gz").write_bytes(b"no gzip at all")
    (inbox / "u4.xml.gz").write_bytes(b"")
    ingest_feed(spark, str(inbox), *home)
    log = articles.read_sync_log(spark, home[1]).select("file", "status", "updated", "new")
    assert rows(log) == [("u1.xml.gz", "ok", 1, 0), *[(f"u{i}.xml.gz", "corrupt", 0, 0) for i in (2, 3, 4)]]
    assert stored(spark, home[0], rows)[0] == ("a", "1", "v")


def test_two_runs_few_files_a_batch_and_a_strict_cut(spark, inbox, tmp_path, rows):
    home = [str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")]
    start_corpus(spark, home[0])
    for i in range(1, 6):
        drop(inbox, f"u{i}.xml.gz", record("1", abstracts=(f"v{i}",)))
    ingest_feed(spark, str(inbox), *home, max_files=2)
    log = articles.read_sync_log(spark, home[1])
    assert rows(log.select("file", "batch_id")) == [(f"u{i}.xml.gz", (i - 1) // 2) for i in range(1, 6)]
    assert stored(spark, home[0], rows)[0] == ("a", "1", "v5")
    ingest_feed(spark, str(inbox), *home, max_files=2)  # nothing new
    assert articles.read_sync_log(spark, home[1]).count() == 5
    drop(inbox, "u0.xml.gz", record("2", abstracts=("late",)))
    drop(inbox, "u6.xml.gz", record("2", abstracts=("next",)))
    ingest_feed(spark, str(inbox), *home, max_files=2)
    assert rows(articles.read_sync_log(spark, home[1]).select("file"))[-1] == ("u6.xml.gz",)
    assert articles.read_sync_log(spark, home[1]).count() == 6  # u0 lies before the cut
    assert last_offset(spark, home[3]) == "u6.xml.gz"
    # A new checkpoint goes on behind what the log has.
    drop(inbox, "u7.xml.gz", record("3", abstracts=("new",)))
    ingest_feed(spark, str(inbox), *home[:3], str(tmp_path / "checkpoint2"), max_files=2)
    assert articles.read_sync_log(spark, home[1]).count() == 7
    assert ("c", "3", "new") in stored(spark, home[0], rows)


def test_a_failed_batch_is_repeated(spark, inbox, tmp_path, rows):
    home = [str(tmp_path / k) for k in ("corpus", "log", "staging", "checkpoint")]
    start_corpus(spark, home[0])
    for i in range(1, 4):
        drop(inbox, f"u{i}.xml.gz", record("1", abstracts=(f"v{i}",)))

    def failing(batch, batch_id):
        raise RuntimeError("lost")

    query = stream_feed_files(spark, str(inbox), home[3], max_files=2).writeStream.foreachBatch(failing).option(
        "checkpointLocation", home[3]).start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    ingest_feed(spark, str(inbox), *home, max_files=2)
    assert rows(articles.read_sync_log(spark, home[1]).select("file", "batch_id")) == [
        ("u1.xml.gz", 0), ("u2.xml.gz", 0), ("u3.xml.gz", 1)]


def test_offsets_do_not_move_before_a_batch_is_planned(inbox):
    for i in range(5):
        (inbox / f"{i}.xml.gz").write_bytes(b"")
    reader = FeedStreamReader({"path": str(inbox), "maxfilesperbatch": "2"})
    start = reader.initialOffset()
    assert start == {"file": ""} and reader.latestOffset() == reader.latestOffset() == {"file": "1.xml.gz"}
    assert [p.name for p in reader.partitions(start, {"file": "1.xml.gz"})] == ["0.xml.gz", "1.xml.gz"]
    assert reader.latestOffset() == {"file": "3.xml.gz"}


def test_writer_keeps_order_and_leaves_whole_files(spark, tmp_path):
    df = spark.range(2000).selectExpr("concat('f', id % 3, '.xml.gz') as feed_file", "-id as feed_pos",
                                      "concat('<PubmedArticle>', id, '</PubmedArticle>') as value")
    for _ in range(2):
        assert write_feed_files(df, str(tmp_path / "feed")) == 3
    assert sorted(p.name for p in (tmp_path / "feed").iterdir()) == ["f0.xml.gz", "f1.xml.gz", "f2.xml.gz"]
    text = gzip.open(tmp_path / "feed" / "f1.xml.gz", "rt").read()
    assert [int(x.split("<")[0]) for x in text.split("<PubmedArticle>")[1:]] == list(range(1999, 0, -3))


def test_hadoop_schemes(monkeypatch):
    from pyarrow import fs

    seen = []

    class Store:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return None, uri.partition("://")[2]

    monkeypatch.setattr(fs, "FileSystem", Store)
    assert open_store("s3a://bucket/a/b")[1:] == ("bucket/a/b", "s3a://") and seen == ["s3://bucket/a/b"]
