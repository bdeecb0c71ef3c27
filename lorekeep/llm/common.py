"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


#: What operators keep in a worker from task to task.
kept_in_worker: list[dict] = []


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, own: dict | None = None,
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each.

    A worker serves many operators: what others than the one with ``own`` have kept in it is forgotten first.
    """
    for other in kept_in_worker:
        if other is not own:
            other.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst): (node, component), the smallest id reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks
    once more, and keeps the edges between what is left. Every node with an edge
    hooks or is hooked to, so the nodes at least halve; chains take a number of
    rounds that grows with the logarithm of their length. Nothing but counts
    reaches the driver. Nodes that only have an edge to themselves, and nulls, are left out.
    """
    cur = settle(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct(), "edges")
    labels = None
    while labels is None or cur.count():
        both = cur.unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = settle(both.groupBy("src").agg(F.min("dst").alias("_m"))
                      .select(F.col("src").alias("node"), F.least("src", "_m").alias("up")), "hooks")
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = settle(hook.join(over, "up").select("node", F.col("top").alias("up")), "hooks")
        a = hook.select(F.col("node").alias("src"), F.col("up").alias("_s"))
        b = hook.select(F.col("node").alias("dst"), F.col("up").alias("_d"))
        cur = settle(cur.join(a, "src").join(b, "dst").where("_s <> _d")
                     .select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst")).distinct(), "edges")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            up = hook.select(F.col("node").alias("component"), F.col("up").alias("_c"))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
        labels = settle(labels, "labels")
    return labels
