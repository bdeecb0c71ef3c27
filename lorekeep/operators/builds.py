"""Build specs, build logs, image sizes and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import printed_size_bytes
from .ordering import first_n

# Fixed value: the line that shows a finished build.
SUCCESS_MARKER = "exporting manifest list"


def parse_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """``tool|apt|pip`` -> three columns; an empty part is null."""
    parts = F.split(F.col(column), "[|]", 3)

    def part(i: int, name: str) -> Column:
        return F.nullif(F.trim(F.try_element_at(parts, F.lit(i))), F.lit("")).alias(name)

    return specs.select(part(1, "tool"), part(2, "apt"), part(3, "pip"))


def build_outcomes(
    specs: DataFrame, logs: DataFrame, marker: str = SUCCESS_MARKER,
    tool: str = "tool", text: str = "text",
) -> DataFrame:
    """A tool succeeded iff some line of its log holds the marker; no log, no success."""
    built = logs.groupBy(tool).agg(F.bool_or(F.contains(F.col(text), F.lit(marker))).alias("_ok"))
    outcome = F.when(F.coalesce("_ok", F.lit(False)), "success").otherwise("failed")
    return specs.join(built, tool, "left").select(*specs.columns, outcome.alias("outcome"))


def compare_sizes(
    sizes: DataFrame, new_tag: str = "new", old_tag: str = "latest", image: str = "image"
) -> DataFrame:
    """Bytes of the new and the old tag of each image side by side, and new/old.

    ``sizes``: image, tag, size_txt. A side that was not printed is null.
    """
    size = printed_size_bytes(F.col("size_txt"))
    wide = sizes.where(F.col("tag").isin(new_tag, old_tag)).groupBy(image).agg(
        F.max(F.when(F.col("tag") == new_tag, size)).cast("bigint").alias("new_bytes"),
        F.max(F.when(F.col("tag") == old_tag, size)).cast("bigint").alias("old_bytes"),
    )
    ratio = F.when(F.col("old_bytes") > 0, F.col("new_bytes").cast("double") / F.col("old_bytes"))
    return wide.withColumn("ratio", ratio)


def first_layers(layers: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` layers of every image in log order, empty layers left out."""
    return first_n(layers.where(~F.startswith(F.col("size_txt"), F.lit("0B"))),
                   ["image"], ["line_no"], n)


def first_match(
    lines: DataFrame, value: Column, group_by: Sequence[str], rank: str = "source_rank",
    line_no: str = "line_no",
) -> DataFrame:
    """The first non-null ``value`` per group: best source first, then the first line."""
    found = lines.select(*group_by, rank, line_no, value.alias("value")).where(
        F.col("value").isNotNull()
    )
    at = F.struct(rank, line_no)
    return found.groupBy(*group_by).agg(
        F.min_by(F.struct(rank, line_no, "value"), at).alias("_hit")
    ).select(*group_by, f"_hit.{rank}", f"_hit.{line_no}", "_hit.value")
