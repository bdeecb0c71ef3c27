"""Two catalogs compared, visibility split, and lists of work that can be resumed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import image_name, visibility_or_unknown
from ..session import settle
from .ordering import ROWS_PER_RANGE, grouped_parts, keys_of


def missing_names(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Names on the old side that the new side lacks, each once."""
    return keys_of(old, name).join(keys_of(new, name), name, "left_anti")


def common_names(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    return keys_of(old, name).join(keys_of(new, name), name, "left_semi")


def missing_tags(
    old_tags: DataFrame, new_tags: DataFrame, common: DataFrame,
    pkg: str = "name", tag: str = "tag",
) -> DataFrame:
    """(package, tag) rows the new side lacks, for packages found on both sides.

    Both sides are made distinct first (with a map-side pass), so the anti join
    runs on unique keys and no package can skew it.
    """
    old, new = keys_of(old_tags, pkg, tag), keys_of(new_tags, pkg, tag)
    return old.join(new, [pkg, tag], "left_anti").join(keys_of(common, pkg), pkg, "left_semi")


def missing_tag_report(
    missing: DataFrame, per_line: int, pkg: str = "name", tag: str = "tag",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Report lines: the sorted missing tags of a package, at most ``per_line`` a line.

    ``parts`` says how many lines the package has.
    """
    missing = settle(missing.select(pkg, tag), "missing-tags")
    parts = grouped_parts(missing, [pkg], [tag], tag, per_line, rows_per_range)
    return parts.select(
        pkg, "part", "parts", F.size("items").cast("bigint").alias("n_tags"),
        F.array_join("items", ",").alias("tags"),
    )


def reconcile_summary(
    old: DataFrame, new: DataFrame, missing: DataFrame, pkg: str = "name"
) -> DataFrame:
    """One row: counts on both sides, packages checked and with gaps, verdict."""
    sides = (
        old.select(pkg).withColumn("_old", F.lit(1)).withColumn("_new", F.lit(0))
        .unionByName(new.select(pkg).withColumn("_old", F.lit(0)).withColumn("_new", F.lit(1)))
        .unionByName(missing.select(pkg).withColumn("_old", F.lit(0)).withColumn("_new", F.lit(0))
                     .withColumn("_gap", F.lit(1)), allowMissingColumns=True)
    )
    per = sides.groupBy(pkg).agg(
        F.max("_old").alias("o"), F.max("_new").alias("n"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("g"),
    )
    counted = per.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("old_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("new_count"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("missing_names"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("checked"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("with_missing_tags"),
    )
    clean = (F.col("missing_names") == 0) & (F.col("with_missing_tags") == 0)
    return counted.withColumn("verdict", F.when(clean, "complete").otherwise("incomplete"))


def public_packages(packages: DataFrame) -> DataFrame:
    return packages.where(F.col("visibility").eqNullSafe("public"))


def non_public_packages(packages: DataFrame) -> DataFrame:
    """Everything that is not public; an unknown visibility counts as not public."""
    return packages.where(~F.col("visibility").eqNullSafe("public"))


def exclude_names(packages: DataFrame, never: DataFrame | Sequence[str], name: str = "name") -> DataFrame:
    if isinstance(never, DataFrame):
        return packages.join(keys_of(never, name), name, "left_anti")
    return packages.where(~F.col(name).isin(list(never)))


def limit_after_filter(packages: DataFrame, keep: Column, n: int, order: str = "name") -> DataFrame:
    """The first ``n`` rows among those that pass ``keep``; 0 means no limit."""
    kept = packages.where(keep)
    return kept.orderBy(order).limit(n) if n else kept


def limit_before_filter(packages: DataFrame, keep: Column, n: int, order: str = "name") -> DataFrame:
    """Those that pass ``keep`` among the first ``n`` rows; 0 means no limit."""
    first = packages.orderBy(order).limit(n) if n else packages
    return first.where(keep)


def with_known_visibility(packages: DataFrame) -> DataFrame:
    return packages.withColumn("visibility", visibility_or_unknown(F.col("visibility")))


def worklist(
    candidates: DataFrame, done: DataFrame, key: str = "key", elsewhere: DataFrame | None = None
) -> DataFrame:
    """Candidates not done yet and, if given, not found at the destination either."""
    todo = candidates.join(keys_of(done, key), key, "left_anti")
    if elsewhere is not None:
        todo = todo.join(keys_of(elsewhere, key), key, "left_anti")
    return todo


def classify_files(
    files: DataFrame, done: DataFrame, elsewhere: DataFrame, order_by: Sequence[str],
    name: str = "file", suffix: str = "_arm64.sif", tag: str = "arm64",
) -> DataFrame:
    """Each file with its key ``<name>:<tag>`` and an outcome.

    ``no_match`` when the name lacks the suffix, ``skipped`` when the key is done,
    is at the destination, or came earlier under another spelling, else ``todo``.
    The first file of a key is found by an aggregate, so a key with very many
    spellings does not end up in one task.
    """
    stem = image_name(F.col(name), suffix)
    keyed = files.withColumn("key", F.when(stem.isNotNull(), F.concat(stem, F.lit(f":{tag}"))))
    first = (
        keyed.where(F.col("key").isNotNull()).groupBy("key")
        .agg(F.min(F.struct(*order_by)).alias("_first"))
    )
    gone = done.select("key").union(elsewhere.select("key")).distinct()
    open_first = first.join(gone, "key", "left_anti")
    here = F.struct(*order_by)
    todo = open_first.select(F.col("key").alias("_k"), "_first")
    joined = keyed.join(todo, (F.col("key") == F.col("_k")) & (here == F.col("_first")), "left")
    outcome = (
        F.when(F.col("key").isNull(), "no_match").when(F.col("_k").isNotNull(), "todo")
        .otherwise("skipped")
    )
    return joined.select(*files.columns, "key", outcome.alias("outcome"))


def outcome_tally(
    df: DataFrame, outcomes: Sequence[str], column: str = "outcome",
    renamed: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows per outcome; every listed outcome shows, also at zero.

    An outcome that is not listed is counted as ``failed``.
    """
    value = F.col(column)
    for old, new in (renamed or {}).items():
        value = F.when(F.col(column) == old, new).otherwise(value)
    value = F.when(value.isin(list(outcomes)), value).otherwise("failed")
    shown = list(dict.fromkeys([*outcomes, "failed"]))
    zeros = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(o) for o in shown])).alias("outcome"),
        F.lit(0).cast("bigint").alias("_n"),
    )
    ones = df.groupBy(value.alias("outcome")).agg(F.count(F.lit(1)).alias("_n"))
    return ones.unionByName(zeros).groupBy("outcome").agg(F.sum("_n").alias("n"))


def planned_actions(todo: DataFrame, action: str, key: str = "name") -> DataFrame:
    """The dry run: what would be done, as rows. Nothing is written."""
    return todo.select(F.lit(action).alias("action"), key)
