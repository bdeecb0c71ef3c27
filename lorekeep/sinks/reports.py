"""Registry, coverage, list and done-log writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordering import ROWS_PER_RANGE, grouped_parts
from ..session import settle


def write_registry(registry: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write one entry per line, in order of category and position.

    This form has no size limit. In a dry run nothing is written; the rows that
    would be are returned either way.
    """
    rows = registry.select(*[c for c in schemas.REGISTRY_ROW.names if c in registry.columns])
    if not dry_run:
        rows.orderBy("category", "position").write.mode("overwrite").json(path)
    return rows


def registry_document(registry: DataFrame) -> DataFrame:
    """The registry as the lines of one nested JSON document: category, position, value.

    In order of category and position the lines are the document. A line is one entry
    with what stands around it, so no task ever holds the document.
    """
    fields = [c for c in registry.columns if c not in ("category", "position")]
    ends = registry.groupBy("category").agg(F.min("position").alias("_first"), F.max("position").alias("_last"))
    edge = ends.agg(F.min("category").alias("lo"), F.max("category").alias("hi"))
    lines = registry.join(ends, "category")
    opens, closes = F.col("position") == F.col("_first"), F.col("position") == F.col("_last")
    lowest, highest = F.col("category") == edge.select("lo").scalar(), F.col("category") == edge.select("hi").scalar()
    name = F.to_json(F.array("category"))
    value = F.concat(
        F.when(opens & lowest, "{").otherwise(""),
        F.when(opens, F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":["))).otherwise(""),
        F.to_json(F.struct(*fields)), F.when(closes, "]").otherwise(","),
        F.when(closes & highest, "}").when(closes, ",").otherwise(""),
    )
    return lines.select("category", "position", value.alias("value"))


def write_registry_document(registry: DataFrame, path: str) -> None:
    """Write the document's lines in order; its part files, read in turn, are the document."""
    lines = registry_document(registry).orderBy("category", "position").select("value")
    if lines.isEmpty():
        lines = registry.sparkSession.createDataFrame([("{}",)], "value string")
    lines.write.mode("overwrite").text(path)


def write_names(names: DataFrame, path: str, name: str = "name") -> None:
    """A sorted list of distinct names, one per line."""
    names.select(name).distinct().orderBy(name).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def append_done(keys: DataFrame, path: str, now: Column | None = None) -> None:
    """Add keys to the done table."""
    stamp = F.current_timestamp() if now is None else now
    keys.select("key", stamp.alias("at")).write.mode("append").parquet(path)


def coverage_documents(
    totals: DataFrame, files: DataFrame, per_document: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Merged coverage reports as JSON text: repo, part, parts, value.

    ``totals``: repo, num_statements, covered_lines, missing_lines,
    percent_covered. ``files``: repo, file, entry (JSON text). A repository with
    more files than ``per_document`` goes on in further parts, whose totals are
    zero, so that merging the parts again gives the same report.
    """
    files = settle(files.select("repo", "file", "entry"), "coverage-files")
    named = files.select("repo", "file", F.struct("file", "entry").alias("_pair"))
    parts = grouped_parts(named, ["repo"], ["file"], "_pair", per_document, rows_per_range)
    joined = totals.join(parts.withColumnRenamed("items", "_pairs"), "repo", "left")
    part = F.coalesce(F.col("part"), F.lit(0))
    first = part == 0
    sums = F.struct(
        *[F.when(first, F.col(c)).otherwise(F.lit(0)).alias(c)
          for c in ("num_statements", "covered_lines", "missing_lines", "percent_covered")],
        F.format_string("%.2f%%", F.when(first, F.col("percent_covered")).otherwise(0.0))
        .alias("percent_covered_display"),
    )
    # Entries are JSON text already, so the map is put together as text.
    entries = F.array_join(
        F.transform("_pairs", lambda p: F.concat(
            F.to_json(F.array(p["file"])).substr(F.lit(2), F.length(F.to_json(F.array(p["file"]))) - 2),
            F.lit(":"), p["entry"])), ",")
    value = F.concat(
        F.lit('{"meta":{},"files":{'), F.coalesce(entries, F.lit("")), F.lit('},"totals":'),
        F.to_json(sums), F.lit("}"),
    )
    return joined.select("repo", part.alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), value.alias("value"))


def write_coverage(documents: DataFrame, path: str) -> None:
    documents.select("value").write.mode("overwrite").text(path)
