import re

import pytest
from pyspark.sql import functions as F

from lorekeep.operators.updates import apply_updates, apply_updates_colocated, latest_per_key
from lorekeep.sinks.bucketed import bucket_count, buckets_of, read_bucketed, update_bucketed, versions, write_bucketed

CORPUS = "pmid string, abstract string, feed_file string, feed_pos long, domain string"
FEED = "pmid string, abstract string, feed_file string, feed_pos long"


@pytest.fixture
def corpus(spark, request):
    name = "c_" + re.sub(r"\W", "_", request.node.name)
    yield name
    for v in versions(spark, name):
        spark.sql(f"DROP TABLE `{name}_v{v}`")


def start(spark, name, path, buckets=8):
    rows = [(str(i % 40), f"old {i}", None if i % 3 else "u1", None if i % 3 else 5, "abc"[i % 3]) for i in range(100)]
    rows += [(None, "no key", None, None, "a")]
    df = spark.createDataFrame(rows, CORPUS)
    write_bucketed(df, name, buckets, path=str(path))
    return df


def feed(spark, n=60, file="u2"):
    return spark.createDataFrame([(str(i % 50), f"new {i}", file, i) for i in range(n)], FEED)


@pytest.mark.parametrize("mode", ["update_only", "upsert"])
def test_update_is_that_of_the_plain_corpus(spark, corpus, tmp_path, rows, mode):
    df = start(spark, corpus, tmp_path)
    order = ("feed_file", "feed_pos")
    for file in ("u2", "u0"):  # a late file never replaces a later one's rows
        latest = latest_per_key(feed(spark, file=file), ["pmid"], order)
        df = spark.createDataFrame(
            apply_updates(df, latest, mode=mode, new_domain="in", newer_by=order).drop("touched").collect(), CORPUS)
        update_bucketed(spark, corpus, feed(spark, file=file), mode=mode, new_domain="in", path=str(tmp_path))
        assert rows(read_bucketed(spark, corpus).select(df.columns)) == rows(df)
    assert versions(spark, corpus) == [2, 3]
    assert sorted(p.name.rpartition("_v")[2] for p in tmp_path.iterdir()) == ["2", "3"]


def test_the_corpus_is_not_shuffled(spark, corpus, tmp_path):
    start(spark, corpus, tmp_path, 4)  # as many as shuffle partitions, so the feed moves once
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = latest_per_key(feed(spark), ["pmid"], ["feed_file", "feed_pos"])
        done = apply_updates_colocated(read_bucketed(spark, corpus), latest, newer_by=["feed_file", "feed_pos"])
        plan = done._jdf.queryExecution().executedPlan().toString()
        done.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    lines = plan.splitlines()
    # The corpus is the left side: above its scan, up to the join, there is no exchange.
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    assert join < scan and not any("Exchange" in x for x in lines[join:scan])
    assert sum("Exchange hashpartitioning" in x for x in lines) == 1


def test_states_and_failures(spark, corpus, tmp_path, rows):
    with pytest.raises(ValueError, match="no corpus"):
        read_bucketed(spark, corpus)
    df = start(spark, corpus, tmp_path)
    broken = feed(spark).withColumn("abstract", F.when(F.col("pmid") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("abstract")))
    with pytest.raises(Exception, match="lost"):
        update_bucketed(spark, corpus, broken, path=str(tmp_path / "x"))
    assert versions(spark, corpus) == [1] and rows(read_bucketed(spark, corpus).select(df.columns)) == rows(df)
    assert buckets_of(spark, f"{corpus}_v1") == 8
    update_bucketed(spark, corpus, feed(spark, 0), path=str(tmp_path))
    assert rows(read_bucketed(spark, corpus).select(df.columns)) == rows(df)


def test_a_bucket_is_one_sorted_file(spark, corpus, tmp_path):
    start(spark, corpus, tmp_path)
    update_bucketed(spark, corpus, feed(spark), path=str(tmp_path))
    for v in (1, 2):
        files = list((tmp_path / f"{corpus}_v{v}").glob("part-*"))
        assert len(files) == len({re.search(r"_(\d{5})\.", f.name)[1] for f in files}) <= 8


def test_bucket_count():
    assert [bucket_count(0), bucket_count(0, 5), bucket_count(1 << 40), bucket_count(1 << 60)] == [1, 8, 2048, 65536]
