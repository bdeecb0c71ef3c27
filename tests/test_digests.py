import pytest
from pyspark.sql import functions as F

from lorekeep.operators import digests, reconcile
from lorekeep.operators.ordering import keys_of

TAGS = "name string, tag string"


def sides(spark):
    """Repeats, nulls, a hot package, packages and tags on one side only."""
    old = [(f"p{i % 60}", f"t{i % 7}") for i in range(300)] + [("hot", f"t{i}") for i in range(200)] * 2 + [(None, "t"), ("p1", None)]
    new = [r for r in old if r not in {("p3", "t1"), ("p3", "t2"), ("hot", "t9")} and r[0] != "p4"]
    new += [("extra", "t1"), ("p5", "more"), ("p6", "t6"), ("p6", "t6")]
    return spark.createDataFrame(old, TAGS), spark.createDataFrame(new, TAGS)


@pytest.mark.parametrize("ranges", [1, 16, 4096])
def test_same_rows_as_the_whole_comparison(spark, rows, ranges):
    for old, new in (sides(spark), sides(spark)[::-1], (sides(spark)[0], sides(spark)[0])):
        assert rows(digests.missing_names_by_digest(old, new, ranges=ranges)) == rows(reconcile.missing_names(old, new))
        want = reconcile.missing_tags(old, new, keys_of(new, "name"))
        assert rows(digests.missing_tags_by_digest(old, new, ranges=ranges)) == rows(want)


def test_summary(spark, rows):
    for old, new in (sides(spark), sides(spark)[::-1], (sides(spark)[0], sides(spark)[0]), (sides(spark)[0].limit(0), sides(spark)[1])):
        old, new = old.dropna(), new.dropna()
        missing = reconcile.missing_tags(old, new, reconcile.common_names(old, new))
        want = reconcile.reconcile_summary(old, new, missing)
        assert rows(digests.summary_by_digest(old, new, ranges=64).select(want.columns)) == rows(want)


def test_equal_ranges_are_not_shuffled(spark, tmp_path):
    """Of two large sides with one difference, one range in 256 goes into the comparison."""
    spark.range(20_000).select(F.col("id").alias("name"), (F.col("id") % 3).alias("tag")).write.parquet(f"{tmp_path}/old")
    old = spark.read.parquet(f"{tmp_path}/old")
    new = old.where("name <> 777")
    wanted = digests.differing_ranges(old, new, "name", ["name", "tag"], 256)
    assert len(wanted) == 1
    assert digests.in_ranges(old, "name", wanted, 256).count() < 20_000 / 256 * 2
    plan = digests.missing_names_by_digest(old, new, ranges=256)._jdf.queryExecution().executedPlan().toString().splitlines()
    # From the scan upwards: the choice of ranges comes before the first exchange.
    for scan in (i for i, x in enumerate(plan) if "FileScan" in x):
        above = [x for x in reversed(plan[:scan])]
        first_filter = next(i for i, x in enumerate(above) if "xxhash64" in x and "Filter" in x)
        first_exchange = next(i for i, x in enumerate(above) if "Exchange" in x)
        assert first_filter < first_exchange
    assert digests.missing_names_by_digest(old, old).count() == 0
    assert digests.differing_ranges(old, old, "name", ["name"]) == []


def test_repeats_and_nulls_show_in_digests(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "1")], TAGS)
    b = spark.createDataFrame([("x", "2"), ("x", "2")], TAGS)
    c = spark.createDataFrame([("x", ""), ("x", None)], TAGS)
    d = spark.createDataFrame([("x", None), ("x", None)], TAGS)
    for one, two in ((a, b), (c, d), (a, a.limit(1)), (c, c)):  # a null equals nothing
        assert digests.differing_ranges(one, two, "name", ["name", "tag"], 1) == [0]
    assert digests.differing_ranges(a, a.orderBy("tag"), "name", ["name", "tag"], 1) == []
