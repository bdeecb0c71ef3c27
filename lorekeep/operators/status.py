"""Status of many repositories from landed status lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import first_n

# Folders that are not repositories of the ecosystem.
NOT_REPOS = ("db-init", "obsolete", "utils", "data", "work")
MAIN_BRANCHES = ("main", "master")


def status_rollup(repos: DataFrame, lines: DataFrame, unpushed: DataFrame) -> DataFrame:
    """Per repository: branch, modified, untracked, unpushed, clean, non_main.

    ``repos``: repo, branch. ``lines``: repo, line. ``unpushed``: repo, unpushed.
    The inputs are counted before they are joined.
    """
    untracked = F.startswith(F.col("line"), F.lit("??"))
    counted = lines.where(F.col("line") != "").groupBy("repo").agg(
        F.count_if(~untracked).alias("modified"), F.count_if(untracked).alias("untracked")
    )
    ahead = unpushed.groupBy("repo").agg(F.sum("unpushed").cast("bigint").alias("unpushed"))
    branch = F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit("unknown"))
    joined = repos.where(~F.col("repo").isin(list(NOT_REPOS))).join(counted, "repo", "left").join(
        ahead, "repo", "left"
    )
    filled = joined.select(
        "repo", branch.alias("branch"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("modified", "untracked", "unpushed")],
    )
    return filled.withColumns({
        "clean": (F.col("modified") + F.col("untracked") + F.col("unpushed")) == 0,
        "non_main": ~F.col("branch").isin(list(MAIN_BRANCHES)),
    })


def status_totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("clean").alias("clean"),
        F.count_if(~F.col("clean")).alias("dirty"), F.count_if("non_main").alias("non_main"),
    )


def dirty_details(rollup: DataFrame, lines: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` status lines of every dirty repository. ``lines`` has line_no."""
    dirty = rollup.where(~F.col("clean")).select("repo")
    return first_n(lines.where(F.col("line") != "").join(dirty, "repo", "left_semi"),
                   ["repo"], ["line_no"], n)


def non_main_repos(rollup: DataFrame) -> DataFrame:
    """Repositories on a known branch other than the main ones."""
    return rollup.where(F.col("non_main") & (F.col("branch") != "unknown")).select("repo", "branch")
