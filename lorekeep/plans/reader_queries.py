"""Readers and sinks over text and files made from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.chunks import assign_chunks
from ..session import work_dir
from ..sinks.corpus import commit_sync_log, write_chunks, write_json_corpus
from ..sinks.reports import append_done, write_names, write_registry, write_registry_document
from ..sources.articles import read_json_corpus, read_sync_log, sync_state
from ..sources.catalogs import (
    explode_tags, parse_listing_status, parse_package_pages, parse_version_pages, read_done_log, read_inventory, read_names,
    read_registry, read_registry_document,
)
from ..sources.reports import parse_coverage, parse_status_lines, parse_unpushed, read_text_tree
from .registry import query


@query("r01_registry_files", """
    SELECT p_brand AS category, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS position,
           p_name AS name, '/ref/' || p_partkey AS path FROM part""")
def registry_files(t):
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = t.part.select(F.col("p_brand").alias("category"), at.cast("bigint").alias("position"),
                         F.col("p_name").alias("name"), F.concat(F.lit("/ref/"), "p_partkey").alias("path"))
    path = work_dir(t.spark, "registry")
    write_registry(rows, path)
    return read_registry(t.spark, path).select("category", "position", "name", "path")


@query("r01b_registry_document", """
    SELECT p_brand AS category, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS position,
           p_name AS name, '/ref/' || p_partkey AS path FROM part""")
def registry_document_files(t):
    """The same registry by way of one nested document in several part files."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = t.part.select(F.col("p_brand").alias("category"), at.cast("bigint").alias("position"),
                         F.col("p_name").alias("name"), F.concat(F.lit("/ref/"), "p_partkey").alias("path"))
    path = work_dir(t.spark, "registry-document")
    write_registry_document(rows, path)
    return read_registry_document(t.spark, path).select("category", "position", "name", "path")


@query("r02_coverage_json", """
    SELECT 'd' || doc_id AS repo, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS num_statements,
           CASE WHEN doc_id % 9 <> 0 THEN n_chars // 2 END AS covered_lines,
           CASE WHEN doc_id % 9 <> 0 THEN n_chars - n_chars // 2 END AS missing_lines FROM documents""")
def coverage_json(t):
    half = F.floor(F.col("n_chars") / 2)
    totals = F.struct(F.col("n_chars").alias("num_statements"), half.alias("covered_lines"),
                      (F.col("n_chars") - half).alias("missing_lines"), F.lit(50.0).alias("percent_covered"))
    text = F.when(F.col("doc_id") % 9 == 0, "{ broken").otherwise(F.to_json(F.struct(totals.alias("totals"))))
    docs = t.documents.select(F.concat(F.lit("d"), "doc_id", F.lit(".json")).alias("file"), text.alias("text"))
    return parse_coverage(docs).drop("percent_covered")


def _package_pages(t):
    row = F.to_json(F.array(F.struct(F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("visibility"))))
    text = F.when(F.col("c_custkey") % 11 == 0, '{"message":"later"}').otherwise(row)
    return t.customer.select(F.concat(F.lit("_p"), "c_custkey", F.lit(".json")).alias("page"), text.alias("text"))


@query("r03_package_pages", "SELECT c_name AS name, lower(c_mktsegment) AS visibility FROM customer WHERE c_custkey % 11 <> 0")
def package_pages(t):
    return parse_package_pages(_package_pages(t)).select("name", "visibility")


@query("r03b_listing_status", """
    SELECT '_p' || c_custkey || '.json' AS page, CASE WHEN c_custkey % 11 = 0 THEN 'failed' ELSE 'ok' END AS listing_status
    FROM customer""")
def listing(t):
    return parse_listing_status(_package_pages(t))


@query("r04_version_tags", """
    SELECT 's' || l_suppkey AS name, unnest(['v' || l_linenumber, 'q' || CAST(l_quantity AS INTEGER)]) AS tag
    FROM lineitem WHERE l_returnflag <> 'N'""")
def version_tags(t):
    # Lines of one kind are versions without tags.
    tags = F.array(F.concat(F.lit("v"), "l_linenumber"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")))
    container = F.struct(F.when(F.col("l_returnflag") != "N", tags).alias("tags"))
    version = F.struct(F.struct(container.alias("container")).alias("metadata"))
    page = F.to_json(F.array(version))
    return explode_tags(parse_version_pages(t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("name"), page.alias("text"))))


@query("r05_status_lines", "SELECT 'r' || user_id AS repo, event_type AS branch, ' M f' || event_id AS line FROM events")
def status_lines(t):
    doc = F.struct(F.concat(F.lit("r"), "user_id").alias("repo"), F.col("event_type").alias("branch"),
                   F.concat(F.lit(" M f"), "event_id").alias("line"))
    return parse_status_lines(t.events.select(F.to_json(doc).alias("value")))


@query("r05b_unpushed", """
    SELECT 'r' || event_id AS repo, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS INTEGER) AS unpushed FROM events""")
def unpushed(t):
    count = F.when(F.col("event_type") == "error", "none").otherwise(F.col("user_id").cast("string"))
    doc = F.struct(F.concat(F.lit("r"), "event_id").alias("repo"), count.alias("unpushed"))
    return parse_unpushed(t.events.select(F.to_json(doc).alias("value")))


@query("r06_sync_state", """
    SELECT max(CASE WHEN event_type <> 'error' THEN 'u' || event_id END) AS last_file, CAST(sum(user_id) AS BIGINT) AS total_updated,
           count(*) AS total_new, count(*) AS files_processed, count(*) AS files FROM events""")
def state_after_two_batches(t):
    path = work_dir(t.spark, "sync-log")
    status = F.when(F.col("event_type") == "error", "corrupt").otherwise("ok")
    rows = t.events.select(
        F.concat(F.lit("u"), "event_id").alias("file"), status.alias("status"), F.col("user_id").alias("updated"),
        F.lit(1).alias("new"), F.col("ts").alias("synced_at"))
    for run, batch, part in (("a", 0, 0), ("a", 1, 1), ("b", 0, 2), ("b", 0, 2)):  # the last is a repeated one
        commit_sync_log(rows.where(F.col("updated") % 3 == part), path, batch, run)
    return sync_state(read_sync_log(t.spark, path)).select(
        "last_file", "total_updated", "total_new", "files_processed", F.size("files").cast("bigint").alias("files"))


@query("r07_done_and_names", """
    SELECT DISTINCT c_name AS key, true AS stamped, c_mktsegment IN (SELECT c_mktsegment FROM customer) AS listed FROM customer""")
def done_and_names(t):
    done, names = work_dir(t.spark, "done"), work_dir(t.spark, "names")
    for part in (0, 1, 1):
        append_done(t.customer.where(F.col("c_custkey") % 2 == part).select(F.col("c_name").alias("key")), done)
    write_names(t.customer.select(F.col("c_mktsegment").alias("name")), names)
    stamps = t.spark.read.parquet(done).groupBy("key").agg(F.bool_and(F.col("at") > "2020-01-01").alias("stamped"))
    listed = read_names(t.spark, names).select(F.col("key").alias("c_mktsegment"), F.lit(True).alias("listed"))
    keys = t.customer.select(F.col("c_name").alias("key"), "c_mktsegment").join(listed, "c_mktsegment", "left")
    return read_done_log(t.spark, done).join(stamps, "key").join(keys, "key").select(
        "key", "stamped", F.coalesce("listed", F.lit(False)).alias("listed")).distinct()


@query("r08_chunk_files", """
    SELECT 'c' || lpad(CAST(57 + rn // 500 AS VARCHAR), 3, '0') AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1""")
def chunk_files(t):
    path = work_dir(t.spark, "chunks")
    rows = t.orders.select(F.col("o_orderkey").alias("pmid"))
    write_chunks(assign_chunks(rows, ["pmid"], "c", size=500, rows_per_range=2000), path)
    stored = t.spark.read.schema("pmid long, chunk string").parquet(path)
    return stored.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("pmid").alias("low"), F.max("pmid").alias("high"))


def _supplier_files(t) -> str:
    """One JSON file per supplier, in a folder per nation."""
    path = work_dir(t.spark, "corpus-files")
    rows = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("pmid"), F.col("s_name").alias("title"), F.lit("text").alias("abstract"),
        F.concat(F.lit("_nation="), F.coalesce(F.col("s_nationkey").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("domain"))
    write_json_corpus(rows, path)
    return path


@query("r09_json_corpus", "SELECT '_nation=' || s_nationkey AS domain, CAST(s_suppkey AS VARCHAR) AS pmid, s_name AS title FROM supplier")
def json_corpus(t):
    return read_json_corpus(t.spark, _supplier_files(t)).select("domain", "pmid", "title")


@query("r10_inventory", "SELECT '_nation=' || s_nationkey AS folder, count(*) AS files, true AS sized FROM supplier GROUP BY 1")
def inventory_of_files(t):
    files = read_inventory(t.spark, _supplier_files(t)).where("is_file and endswith(path, '.json')")
    return files.groupBy(F.split("path", "/")[0].alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.bool_and(F.col("size") > 0).alias("sized"))


@query("r11_text_tree", """
    SELECT '_nation=' || s_nationkey AS folder, s_name AS name FROM supplier WHERE s_nationkey <> 3""")
def text_tree(t):
    files = read_text_tree(t.spark, _supplier_files(t), excluded_dirs=("_nation=3",), excluded_extensions=("crc", "log"))
    files = files.where("endswith(path, '.json')")
    return files.select(F.split("path", "/")[0].alias("folder"), F.get_json_object("text", "$.title").alias("name"))
