"""Coverage reports: merge of parts, report with bands, weighted total, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coverage_band, percent
from .updates import merge_maps_last_wins

# Percents from which a report is good, and fair.
THRESHOLD = 90.0
WARN = 80.0


def merge_parts(parts: DataFrame, repo: str = "repo") -> DataFrame:
    """Sum of the parts of each repository; percent from the sums, two decimals (a tie
    goes to the even digit).

    ``parts``: repo, num_statements, covered_lines, missing_lines.
    """
    summed = parts.groupBy(repo).agg(
        *[F.sum(c).alias(c) for c in ("num_statements", "covered_lines", "missing_lines")]
    )
    return summed.withColumn(
        "percent_covered", F.bround(percent(F.col("covered_lines"), F.col("num_statements")), 2)
    )


def merge_files(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Union of the per-file entries of all parts; on a clash the later part wins.

    ``files``: repo, part, file, entry.
    """
    return merge_maps_last_wins(files, [repo, "file"], ["part"])


def merge_counts(counts: DataFrame, repo: str = "repo") -> DataFrame:
    return counts.groupBy(repo).agg(F.sum("tests").alias("tests"))


def coverage_report(
    reports: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, warn: float = WARN,
    repo: str = "repo",
) -> DataFrame:
    """Each report with its test count (0 if unknown) and band.

    ``reports``: repo, num_statements, covered_lines, percent_covered. A report
    that lacks one of them is unreadable: it counts as zeros, band ``unknown``.
    """
    needed = ("num_statements", "covered_lines", "percent_covered")
    joined = reports.join(counts.select(repo, "tests"), repo, "left")
    readable = F.lit(True)
    for c in needed:
        readable = readable & F.col(c).isNotNull()

    def or_zero(c: str, zero=0):
        return F.when(readable, F.coalesce(F.col(c), F.lit(zero))).otherwise(F.lit(zero)).alias(c)

    pct = F.when(readable, F.col("percent_covered"))
    return joined.select(
        repo, or_zero("num_statements"), or_zero("covered_lines"), or_zero("tests"),
        or_zero("percent_covered", 0.0), coverage_band(pct, threshold, warn).alias("band"),
    )


def weakest_first(report: DataFrame, repo: str = "repo") -> DataFrame:
    return report.orderBy("percent_covered", repo)


def coverage_total(report: DataFrame) -> DataFrame:
    """One row of sums with the percent of the sums, not the mean of percents."""
    return report.agg(
        F.count(F.lit(1)).alias("repos"),
        F.coalesce(F.sum("tests"), F.lit(0)).alias("tests"),
        F.coalesce(F.sum("num_statements"), F.lit(0)).alias("num_statements"),
        F.coalesce(F.sum("covered_lines"), F.lit(0)).alias("covered_lines"),
    ).withColumn("percent_covered", percent(F.col("covered_lines"), F.col("num_statements")))


def coverage_rollup(report: DataFrame, repo: str = "repo", total: str = "TOTAL") -> DataFrame:
    """A row per repository and a total row, both with the weighted percent."""
    rolled = report.rollup(repo).agg(
        F.sum("tests").alias("tests"), F.sum("num_statements").alias("num_statements"),
        F.sum("covered_lines").alias("covered_lines"), F.grouping(repo).alias("_all"),
    )
    return rolled.select(
        F.when(F.col("_all") == 1, total).otherwise(F.col(repo)).alias(repo),
        "tests", "num_statements", "covered_lines",
        percent(F.col("covered_lines"), F.col("num_statements")).alias("percent_covered"),
    )


def coverage_gaps(report: DataFrame, threshold: float = THRESHOLD, repo: str = "repo") -> DataFrame:
    """Repositories below the threshold but above zero, with the distance to it."""
    pct = F.col("percent_covered")
    return report.where((pct > 0) & (pct < threshold)).select(
        repo, pct, (F.lit(threshold) - pct).alias("gap")
    )
