import pytest
from pyspark.sql import functions as F

from lorekeep.functions.scalars import escape_path, escape_slashes, image_name
from lorekeep.operators import reconcile
from lorekeep.sinks.reports import append_done, write_names
from lorekeep.sources import catalogs


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_missing_and_common(spark, rows):
    old, new = names(spark, "a", "b", "b", "c"), names(spark, "b", "d")
    assert rows(reconcile.missing_names(old, new)) == [("a",), ("c",)]
    assert rows(reconcile.common_names(old, new)) == [("b",)]


def test_tags(spark, rows):
    schema = "name string, metadata struct<container:struct<tags:array<string>>>"
    old = spark.createDataFrame([("p", ((["t1", "t2", "t1"],),)), ("p", ((None,),)), ("p", (None,)), ("q", ((["x"],),)),
                                 ("only", ((["z"],),)), ("p", (([],),))], schema)
    new = spark.createDataFrame([("p", ((["t2"],),)), ("q", ((["x", "y"],),))], schema)
    old_tags, new_tags = catalogs.explode_tags(old), catalogs.explode_tags(new)
    assert old_tags.count() == 5
    common = reconcile.common_names(old, new)
    missing = reconcile.missing_tags(old_tags, new_tags, common)
    assert rows(missing) == [("p", "t1")]
    assert rows(reconcile.missing_tag_report(missing, per_line=9)) == [("p", 0, 1, 1, "t1")]
    summary = reconcile.reconcile_summary(old, new, missing).first()
    assert tuple(summary) == (3, 2, 1, 2, 1, "incomplete")
    clean = reconcile.reconcile_summary(new, new, missing.limit(0)).first()
    assert clean.verdict == "complete"
    assert missing.join(new_tags, ["name", "tag"], "left_semi").count() == 0


def test_report_lines_of_a_hot_package(spark):
    missing = spark.range(950).select(F.lit("hot").alias("name"), F.lpad(F.col("id").cast("string"), 4, "0").alias("tag"))
    lines = reconcile.missing_tag_report(missing, per_line=100, rows_per_range=64).orderBy("part").collect()
    assert [r.n_tags for r in lines] == [100] * 9 + [50]
    assert ",".join(r.tags for r in lines).split(",") == [f"{i:04d}" for i in range(950)]


def test_visibility_and_limits(spark, rows):
    df = spark.createDataFrame([("a", "public"), ("b", None), ("c", "private"), ("d", "public"), ("e", "internal")],
                               "name string, visibility string")
    assert [r[0] for r in rows(reconcile.public_packages(df))] == ["a", "d"]
    assert [r[0] for r in rows(reconcile.non_public_packages(df))] == ["b", "c", "e"]
    known = reconcile.with_known_visibility(df)
    private = F.col("visibility") != "public"
    assert [r[0] for r in rows(reconcile.limit_after_filter(known, private, 2))] == ["b", "c"]
    assert [r[0] for r in rows(reconcile.limit_before_filter(known, private, 2))] == ["b"]
    assert reconcile.limit_after_filter(known, private, 0).count() == 3
    assert reconcile.exclude_names(known, ["b", "zz"]).count() == 4
    assert reconcile.exclude_names(known, names(spark, "b", "c")).count() == 3


def test_two_column_lines(spark, rows):
    df = spark.createDataFrame([("a\tpublic",), ("",), ("  ",), ("b",), ("c\tx\ty",), ("d\t",)], "value string")
    assert rows(catalogs.two_column_lines(df)) == [("a", "public"), ("d", "")]


def test_name_lists_and_done_log(spark, tmp_path, rows):
    (tmp_path / "list.txt").write_text("a \n\n  b\na\n \t\n")
    assert rows(catalogs.read_names(spark, str(tmp_path / "list.txt"))) == [("a",), ("b",)]
    assert catalogs.read_names(spark, str(tmp_path / "no.txt")).count() == 0
    log = str(tmp_path / "done")
    assert catalogs.read_done_log(spark, log).count() == 0
    for _ in range(2):
        append_done(spark.createDataFrame([("a",)], "key string"), log)
    assert rows(catalogs.read_done_log(spark, log)) == [("a",)]
    todo = reconcile.worklist(catalogs.read_names(spark, str(tmp_path / "list.txt")), catalogs.read_done_log(spark, log))
    assert rows(todo) == [("b",)]
    write_names(names(spark, "z", "y", "z"), str(tmp_path / "sorted"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sorted")).collect()] == ["y", "z"]


def test_listing_pages(spark, tmp_path, rows):
    (tmp_path / "p1.json").write_text('[{"name":"a","visibility":"public"},{"name":"b"}]')
    (tmp_path / "p2.json").write_text("[]")
    (tmp_path / "p3.json").write_text('{"message": "Bad credentials')
    assert rows(catalogs.read_package_pages(spark, str(tmp_path))) == [("a", "public"), ("b", None)]
    assert rows(catalogs.listing_status(spark, str(tmp_path))) == [
        ("p1.json", "ok"), ("p2.json", "ok"), ("p3.json", "failed")]


def test_image_files(spark, rows):
    files = spark.createDataFrame(
        [(1, "Tool_arm64.sif"), (2, "TOOL_arm64.sif"), (3, "x.sif"), (4, "done_arm64.sif"), (5, "there_arm64.sif"),
         (6, "a_arm64_arm64.sif"), (7, "DONE_arm64.sif")], "pos int, file string")
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    out = reconcile.classify_files(files, keys("done:arm64"), keys("there:arm64"), ["pos"])
    assert rows(out.select("pos", "key", "outcome")) == [
        (1, "tool:arm64", "todo"), (2, "tool:arm64", "skipped"), (3, None, "no_match"), (4, "done:arm64", "skipped"),
        (5, "there:arm64", "skipped"), (6, "a_arm64:arm64", "todo"), (7, "done:arm64", "skipped")]
    tally = reconcile.outcome_tally(out, ["pushed", "skipped", "no_match"], renamed={"todo": "pushed"})
    assert rows(tally) == [("failed", 0), ("no_match", 1), ("pushed", 2), ("skipped", 4)]


def test_unlisted_outcome_counts_as_failed(spark, rows):
    df = spark.createDataFrame([("changed",), ("error: x",), (None,)], "outcome string")
    assert rows(reconcile.outcome_tally(df, ["changed", "already_public"])) == [
        ("already_public", 0), ("changed", 1), ("failed", 2)]


@pytest.mark.parametrize("name, slashes, full", [("a/b c", "a%2Fb c", "a%2Fb%20c"), ("x~y*é", "x~y*é", "x~y%2A%C3%A9")])
def test_escapes(spark, name, slashes, full):
    got = spark.range(1).select(escape_slashes(F.lit(name)), escape_path(F.lit(name)), image_name(F.lit("x"))).first()
    assert tuple(got) == (slashes, full, None)
