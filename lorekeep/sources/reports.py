"""Text trees, coverage reports, status lines, build logs and run snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import json_row_count, json_state
from ..operators.ordering import ROWS_PER_RANGE, carry_down, dense_index
from ..operators.textscan import SCAN_EXCLUDED_DIRS, is_binary, lacks_extension, outside_dirs
from ..session import settle
from .catalogs import path_text
from .files import list_tree, read_texts

# Fixed value: the file that holds the test counts.
SIDECAR = "test_counts.json"


def read_text_tree(
    spark: SparkSession, root: str, excluded_dirs: Sequence[str] = SCAN_EXCLUDED_DIRS,
    excluded_extensions: Sequence[str] = ("log",),
) -> DataFrame:
    """Text files below ``root`` as (path, text), binary files and ``*.log`` left out.

    Excluded folders are not entered; names may begin with ``.`` or ``_``.
    """
    files = list_tree(spark, root, skip=tuple(excluded_dirs)).where("is_file")
    wanted = outside_dirs(F.col("path"), excluded_dirs) & lacks_extension(F.col("path"), excluded_extensions)
    return read_texts(files.where(wanted)).select("path", "text").where(~is_binary(F.col("text")))


def parse_coverage(docs: DataFrame) -> DataFrame:
    """Totals of coverage documents (file, text): repo, totals; an unreadable report has null totals."""
    totals = F.from_json("text", schemas.COVERAGE)["totals"]
    return docs.select(
        F.replace("file", F.lit(".json"), F.lit("")).alias("repo"), totals.alias("_t")
    ).select("repo", "_t.num_statements", "_t.covered_lines", "_t.missing_lines", "_t.percent_covered")


def read_coverage(spark: SparkSession, root: str, skip: Sequence[str] = ()) -> DataFrame:
    """Coverage reports of a folder: repo, totals; an unreadable report has null totals."""
    docs = spark.read.option("pathGlobFilter", "*.json").text(root, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )
    return parse_coverage(docs.where(~F.col("file").isin([*skip, SIDECAR])))


def read_coverage_files(spark: SparkSession, root: str, parts: Sequence[str]) -> DataFrame:
    """(part, file, entry) of the given part reports, in the order they are named."""
    place = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("_file"))
    docs = spark.read.text(root, wholetext=True).select(
        F.col("_metadata.file_name").alias("_file"), "value"
    ).where(F.col("_file").isin(list(parts)))
    files = F.from_json("value", schemas.COVERAGE)["files"]
    return docs.select(place.alias("part"), F.explode(files).alias("file", "entry"))


def read_test_counts(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar map repo -> count as rows."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("repo", "tests"))


def parse_status_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (value) -> repo, branch, line."""
    return lines.select(F.from_json("value", schemas.STATUS_LINE).alias("_s")).select("_s.*").where(F.col("repo").isNotNull())


def parse_unpushed(lines: DataFrame) -> DataFrame:
    """JSON lines (value) -> repo, unpushed; a count that is no number is 0, as for a repository without upstream."""
    doc = F.from_json("value", "repo string, unpushed string")
    return lines.select(doc.alias("_u")).where(F.col("_u.repo").isNotNull()).select(
        "_u.repo", F.coalesce(F.col("_u.unpushed").try_cast("int"), F.lit(0)).alias("unpushed"))


def read_status_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed status lines (repo, branch, line) as JSON lines."""
    return parse_status_lines(spark.read.text(path))


def read_unpushed(spark: SparkSession, path: str) -> DataFrame:
    """Landed counts of unpushed commits (repo, unpushed) as JSON lines."""
    return parse_unpushed(spark.read.text(path))


def parse_snapshots(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """JSON snapshots -> run_id, state, rows_count; other columns are kept."""
    keep = [c for c in docs.columns if c != doc]
    return docs.select(
        *keep, F.get_json_object(doc, "$.run_id").alias("run_id"),
        json_state(F.col(doc)).alias("state"), json_row_count(F.col(doc)).alias("rows_count"),
    )


def read_snapshots(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Run snapshots kept as JSON lines: run_id, state, rows_count, observed_at."""
    reader = spark.readStream if streaming else spark.read
    docs = reader.text(path).select(
        F.get_json_object("value", "$.observed_at").try_cast("timestamp").alias("observed_at"),
        F.col("value").alias("doc"),
    )
    return parse_snapshots(docs)


def read_build_log(
    spark: SparkSession, path: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Build logs as numbered lines: file, log, line_no, text.

    ``file`` is the whole path, by which lines are counted, ``log`` the name alone.

    A log may be read in several splits: a split knows where it starts, and the row
    id rises within it, so both together give the order of lines. They are settled
    before the lines are counted through.
    """
    lines = spark.read.text(path).select(
        path_text(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_name").alias("log"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"),
    )
    numbered = dense_index(
        settle(lines, "build-log"), ["_start", "_id"], "line_no", ["file"], rows_per_range)
    return numbered.select("file", "log", (F.col("line_no") + 1).alias("line_no"), "text")


def _with_header(lines: DataFrame, rows_per_range: int) -> DataFrame:
    """Carry the ``-- name --`` header of a section down to its lines, file by file."""
    header = F.nullif(F.regexp_extract("text", r"^── (.+) ──\s*$", 1), F.lit(""))
    return carry_down(lines, ["line_no"], "image", header, ["file"], rows_per_range)


def parse_build_log(lines: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows of the three kinds in a build log.

    ``kind`` is ``size`` (tag, size, created), ``layer`` (size, command) or
    ``built``; ``image`` is the header above, or the image named in the line.
    """
    # The three kinds of lines as the log has them.
    size_row = r"^\s*(\S+)\t([0-9.]+[kMGT]?B)\t(.+)$"
    layer_row = r"^([0-9.]+[kMGT]?B)\t(.*)$"
    built_row = r"^✅ (\S+) built successfully"
    text = F.col("text")
    kind = (
        F.when(text.rlike(built_row), "built").when(text.rlike(size_row), "size")
        .when(text.rlike(layer_row), "layer")
    )
    out = _with_header(lines, rows_per_range).withColumn("kind", kind).where(F.col("kind").isNotNull())
    is_size, is_layer = F.col("kind") == "size", F.col("kind") == "layer"
    return out.select(
        "file", "line_no", "kind",
        F.when(F.col("kind") == "built", F.regexp_extract(text, built_row, 1))
        .otherwise(F.col("image")).alias("image"),
        F.when(is_size, F.regexp_extract(text, size_row, 1)).alias("tag"),
        F.when(is_size, F.regexp_extract(text, size_row, 2))
        .when(is_layer, F.regexp_extract(text, layer_row, 1)).alias("size_txt"),
        F.when(is_size, F.regexp_extract(text, size_row, 3)).alias("created"),
        F.when(is_layer, F.regexp_extract(text, layer_row, 2)).alias("command"),
    )
