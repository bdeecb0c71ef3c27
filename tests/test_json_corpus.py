"""Corpora of one JSON file per row: written by many tasks, read back whole."""

import json
import os

from __spark_entry__ import queries
from lorekeep.plans import reader_queries
from lorekeep.plans.views import Tables
from lorekeep.sinks.corpus import write_json_corpus
from lorekeep.sources.articles import read_json_corpus

SUPPLIERS = [(i, f"S{i % 7}", i % 3) for i in range(60)] + [(5, "S5", 2), (None, None, 1), (9, "n", None)]


def files_of(path):
    path = path.removeprefix("file:")
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_supplier_files_are_written_by_several_tasks(spark, tmp_path):
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(
        str(tmp_path / "supplier.parquet"))
    found = [f for f in files_of(reader_queries._supplier_files(Tables(spark, str(tmp_path)))) if f.endswith(".json")]
    assert len(found) == len(SUPPLIERS)
    assert len({f.rpartition("/")[2].split("-")[1] for f in found}) > 1


def test_queries_over_supplier_files(spark, rows, tmp_path):
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_name string, s_nationkey int").write.parquet(
        str(tmp_path / "supplier.parquet"))
    none = "__HIVE_DEFAULT_PARTITION__"
    folder = lambda n: f"_nation={none if n is None else n}"
    got = {n: rows(queries()[n](spark, str(tmp_path))) for n in ("r10_inventory", "r11_text_tree")}
    count = {folder(n): sum(s[2] == n for s in SUPPLIERS) for n in {s[2] for s in SUPPLIERS}}
    assert got["r10_inventory"] == sorted(((f, n, True) for f, n in count.items()), key=repr)
    assert got["r11_text_tree"] == sorted(((folder(n), name) for _, name, n in SUPPLIERS), key=repr)


def test_domains_of_any_name(spark, rows, tmp_path):
    articles = [("1", "t", "a/b"), ("1", "t", "a/b"), ("2", None, ".."), ("3", "ü\n", "x y"), ("4", "t", None)]
    df = spark.createDataFrame(articles, "pmid string, title string, domain string")
    assert write_json_corpus(df, str(tmp_path / "c")) == 5
    found = files_of(str(tmp_path / "c"))
    assert len(found) == 5 and not any(f.rpartition("/")[2].startswith(".") for f in found)
    for f in found:
        text = (tmp_path / "c" / f).read_text()
        assert text.endswith("}\n") and json.loads(text)["pmid"] in "1234"
    got = rows(read_json_corpus(spark, str(tmp_path / "c")).select("domain", "pmid"))
    assert got == [("%2E%2E", "2"), ("__HIVE_DEFAULT_PARTITION__", "4"), ("a%2Fb", "1"), ("a%2Fb", "1"), ("x y", "3")]


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "pmid string, domain string")
    assert write_json_corpus(df, str(tmp_path / "none")) == 0
    assert read_json_corpus(spark, str(tmp_path / "none")).count() == 0
