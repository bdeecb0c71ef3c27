"""Issue counts, label gaps, and topic payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ROWS_PER_RANGE, grouped_parts

# Priorities in the order they are shown.
PRIORITIES = ("Critical", "High", "Medium", "Low")
# Fixed value: the id that a dry run gives.
DRY_NODE = "DRY_NODE"


def shown_title(title: Column, width: int = 60) -> Column:
    return F.substring(title, 1, width)


def with_priority_label(issues: DataFrame) -> DataFrame:
    """``labels`` with the priority appended."""
    return issues.withColumn("labels", F.array_append("labels", F.col("priority")))


def counts_by_priority(issues: DataFrame, order: Sequence[str] = PRIORITIES) -> DataFrame:
    """Issues per listed priority, in that order; a priority without issues is hidden."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("priority"))
    counted = issues.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", place.cast("bigint")).where(F.col("place") > 0).orderBy("place")


def counts_by_repo(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy("repo")


def repos_touched(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo").agg(F.lit(1).alias("_r")).agg(F.count(F.lit(1)).alias("repos"))


def linked_total(issues: DataFrame, node_id: str = "node_id") -> DataFrame:
    """How many rows have an id and can be linked, of how many."""
    has = F.col(node_id).isNotNull() & ~F.col(node_id).isin("", DRY_NODE)
    return issues.agg(F.count_if(has).alias("linked"), F.count(F.lit(1)).alias("total"))


def missing_labels(
    repos: DataFrame, labels: Sequence[str], existing: DataFrame, repo: str = "repo"
) -> DataFrame:
    """Every (repository, catalogue label) that does not exist yet.

    The catalogue is a parameter, so each repository row is widened in place;
    there is no join to form the pairs.
    """
    wanted = repos.select(repo).distinct().select(
        repo, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    )
    return wanted.join(existing.select(repo, "label").distinct(), [repo, "label"], "left_anti")


def label_plan(missing: DataFrame, colours: Mapping[str, str], default: str = "ededed") -> DataFrame:
    """``missing`` labels with the colour to create them in; a label without one gets ``default``."""
    known = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair]) if colours else None
    colour = F.lit(default) if known is None else F.coalesce(F.try_element_at(known, F.col("label")), F.lit(default))
    return missing.withColumn("colour", colour)


def topic_payloads(
    topics: DataFrame, per_payload: int, repo: str = "repo", order_by: str = "pos", topic: str = "topic",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``{"names":[...]}`` per repository, topics in order and repeats kept.

    More than ``per_payload`` topics go on in further payloads (part 1, 2, ...). A payload
    that is sent replaces the repository's list, so one with ``parts`` above 1 has to be joined first.
    """
    parts = grouped_parts(topics, [repo], [order_by], topic, per_payload, rows_per_range)
    return parts.select(
        repo, "part", "parts", F.to_json(F.struct(F.col("items").alias("names"))).alias("payload")
    )
