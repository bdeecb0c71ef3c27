import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators.ordering import carry_down, cut_points, dense_index, first_n, grouped_parts, running_sum


@pytest.mark.parametrize("per_range", [10_000, 300, 7])
def test_dense_index_is_contiguous(spark, per_range):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"))
    out = dense_index(df, ["k"], rows_per_range=per_range)
    assert out.where("idx <> k").count() == 0
    assert out.count() == 2000


def test_index_within_a_hot_group_spans_ranges(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.hash("id").alias("k"), "id")
    cuts = cut_points(df, ["g", "k"], 100)[0].first()
    assert sum(len(b) for b in cuts.blocks) == 29 and sorted(cuts.heads) == cuts.heads
    out = dense_index(df, ["k", "id"], "i", ["g"], rows_per_range=100)
    w = Window.partitionBy("g").orderBy("k", "id")
    assert out.withColumn("want", F.row_number().over(w) - 1).where("i <> want").count() == 0


def test_nulls_come_first_and_form_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", None), ("b", 4)], "g string, k int")
    big = df.union(df).union(df)
    out = dense_index(big, ["k"], "i", ["g"], rows_per_range=3)
    got = out.groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert {r.g: r.i for r in got} == {None: [0, 1, 2, 3, 4, 5], "a": [0, 1, 2, 3, 4, 5], "b": [0, 1, 2]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=60),
       per_range=st.integers(1, 20))
def test_running_sum_matches_brute_force(spark, data, per_range):
    rows = [(g, i, v) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    got = {r.i: r.s for r in running_sum(df, ["i"], {"s": F.col("v")}, ["g"], per_range).collect()}
    want, totals = {}, {}
    for g, i, v in rows:
        totals[g] = totals.get(g, 0) + v
        want[i] = totals[g]
    assert got == want


def test_heading_is_carried_over_ranges(spark):
    df = spark.range(900).select(
        F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"), "id",
        F.when(F.col("id") % 250 == 3, F.concat(F.lit("h"), "id")).alias("h"))
    out = carry_down(df, ["id"], "seen", F.col("h"), ["g"], rows_per_range=40)
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("seen", F.last("h", ignorenulls=True).over(w))
    assert out.count() == 900
    assert out.exceptAll(want).count() == 0 and out.where("seen is null").count() == 3 + 53


def test_grouped_parts_keep_order_and_lose_nothing(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"), "id")
    got = {}
    for r in grouped_parts(df, ["g"], ["id"], "id", 64, rows_per_range=50).orderBy("g", "part").collect():
        assert len(r["items"]) <= 64
        got.setdefault(r.g, []).extend(r["items"])
    assert got == {"hot": list(range(700)), "cold": list(range(700, 1000))}


@pytest.mark.parametrize("n", [3, 1500])
def test_first_n_small_and_salted(spark, n):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"), "id")
    got = first_n(df, ["g"], ["id"], n)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(f"rank <= {n}")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("partitions, limits", [("1", 2), ("4", 4)])
def test_small_limit_is_cut_before_the_shuffle(spark, partitions, limits):
    """One window, cut before its shuffle and after it; with salts there are two of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
        plan = first_n(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("WindowGroupLimit") == limits
