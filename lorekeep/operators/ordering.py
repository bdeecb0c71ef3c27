"""Ordered operators that never sort everything, or one hot group, in one task.

A plain ``row_number()`` over the whole table, or over a group that holds a third
of it, puts those rows into one task. The operators here cut the order into
ranges first. The cut points are a small sorted sample of the order key; they
only steer the balance, the result is exact for any cut. They are written down
once, so a task that runs again after an executor loss uses the same cuts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

ROWS_PER_RANGE = 100_000
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 20
BROADCAST_RANGES = 500_000


def keys_of(df: DataFrame, *columns: str) -> DataFrame:
    """Each key once: the side of a semi or anti join that is only asked for presence.

    A key that fills a third of that side is then one row per map task, not one
    sort-merge partition that nothing can split.
    """
    return df.select(*columns).distinct()


def _order_key(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)])


def cut_points(df: DataFrame, order_by: Sequence[str], rows_per_range: int) -> tuple[DataFrame, int] | None:
    """One row that cuts the order into ranges of about ``rows_per_range`` rows.

    Column ``blocks`` holds the cuts in order, in blocks of a width that is given
    as well (about the square root of their number); ``heads`` the first cut of
    each block. None if one range is enough. Runs two narrow jobs (a count, and a sample of at most about
    ``MAX_RANGES * SAMPLES_PER_RANGE`` keys, whatever the input). The row is
    written down, so every later job, and every repeated task, sees the same cuts.
    """
    keys = df.select(_order_key(order_by).alias("k"))
    rows = keys.count()
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    if ranges <= 1:
        return None
    share = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    drawn = keys.sample(share, seed=11).agg(F.array_sort(F.collect_list("k")).alias("ks"))
    n = F.size("ks")
    places = F.transform(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(ranges - 1)), F.lit(1))),
        lambda i: F.ceil(i * n / F.lit(ranges)).cast("int"),
    )
    cuts = drawn.where(n > 0).select(
        F.transform(places, lambda i: F.element_at("ks", F.greatest(i, F.lit(1)))).alias("cuts"))
    width = max(1, math.isqrt(ranges))
    starts = F.sequence(F.lit(1), F.size("cuts"), F.lit(width))
    blocks = cuts.select(F.transform(starts, lambda i: F.slice("cuts", i, F.lit(width))).alias("blocks"))
    row = blocks.select("blocks", F.transform("blocks", lambda b: b[0]).alias("heads"))
    return settle(row.coalesce(1), "cuts"), width


def _range_no(key: Column, cuts: DataFrame, width: int) -> Column:
    """How many cuts are < key: a coarse look-up, then a fine one in that block.

    Each look-up puts the key into a short sorted array and asks for its place.
    (A lambda over the cuts would read better, but the optimizer loses track of
    the columns a lambda captures once the result is a join key.)
    """
    def below(points: Column) -> Column:
        return F.array_position(F.sort_array(F.array_append(points, key)), key) - 1

    block = F.greatest(below(cuts.select("heads").scalar()), F.lit(1)).cast("int")
    fine = F.element_at(cuts.select("blocks").scalar(), block)
    return F.coalesce(((block - 1) * width + below(fine)).cast("int"), F.lit(0))


def running_sum(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Mapping[str, Column],
    group_by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add running sums (first row up to this one) over ``order_by``.

    With ``group_by`` the sums restart in every group; a group of any size is
    spread over as many ranges as it fills. ``order_by`` should make the order
    total within the group.

    The input is read four times (count, sample, offsets, rows), the first three
    on the order columns only. Settle it first (``session.settle``) when it is
    the result of joins.
    """
    group_by, order_by = list(group_by), list(order_by)
    terms = {name: f"_term_{i}" for i, name in enumerate(sums)}
    work = df.select("*", *[c.cast("bigint").alias(terms[n]) for n, c in sums.items()])
    work, one_range = _with_ranges(work, df, order_by, group_by, rows_per_range)
    local = work.select(
        *df.columns, "_range",
        *[F.sum(t).over(_inside(order_by, group_by)).alias(n) for n, t in terms.items()],
    )
    if one_range:
        return local.drop("_range")
    totals = work.groupBy("_range", *group_by).agg(*[F.sum(t).alias(t) for t in terms.values()])
    offsets = totals.select(
        "_range", *group_by,
        *[F.coalesce(F.sum(t).over(_before(group_by)), F.lit(0)).alias(f"{t}_before")
          for t in terms.values()],
    )
    return _join_offsets(local, offsets, group_by).select(
        *df.columns, *[(F.col(n) + F.col(f"{t}_before")).alias(n) for n, t in terms.items()]
    )


def carry_down(
    df: DataFrame,
    order_by: Sequence[str],
    name: str,
    value: Column,
    group_by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the last non-null ``value`` up to each row, as a heading holds for the
    lines below it. Spread over ranges like :func:`running_sum`.
    """
    group_by, order_by = list(group_by), list(order_by)
    work, one_range = _with_ranges(
        df.withColumn("_value", value), df, order_by, group_by, rows_per_range)
    last = F.last("_value", ignorenulls=True).over(_inside(order_by, group_by))
    local = work.select(*df.columns, "_range", last.alias(name))
    if one_range:
        return local.drop("_range")
    at = F.when(F.col("_value").isNotNull(), F.struct(*order_by))
    totals = work.groupBy("_range", *group_by).agg(F.max_by("_value", at).alias("_last"))
    carried = totals.select(
        "_range", *group_by, F.last("_last", ignorenulls=True).over(_before(group_by)).alias("_carried")
    )
    return _join_offsets(local, carried, group_by).select(
        *df.columns, F.coalesce(F.col(name), F.col("_carried")).alias(name)
    )


def _with_ranges(work, df, order_by, group_by, rows_per_range) -> tuple[DataFrame, bool]:
    """``work`` with its range number, and whether one range is enough."""
    full_order = group_by + [c for c in order_by if c not in group_by]
    cuts = cut_points(df, full_order, rows_per_range)
    place = F.lit(0) if cuts is None else _range_no(_order_key(full_order), *cuts)
    return work.withColumn("_range", place), cuts is None


def _inside(order_by, group_by):
    return Window.partitionBy("_range", *group_by).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def _before(group_by):
    """Over one row per (range, group): at most groups + ranges rows, and at most
    MAX_RANGES of them per group, so this window is small by construction.
    """
    return Window.partitionBy(*group_by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def _join_offsets(local: DataFrame, offsets: DataFrame, group_by) -> DataFrame:
    if group_by:
        return _join_null_safe(local, offsets, ["_range", *group_by])
    return local.join(F.broadcast(offsets), "_range")  # at most MAX_RANGES rows


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for key in keys:
        test = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        on = test if on is None else on & test
    return left.join(right, on).drop(*[f"_r_{k}" for k in keys])


def dense_index(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "idx",
    group_by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add a contiguous index from 0 over ``order_by`` (per group with ``group_by``).

    Rows are shuffled once, into as many ranges of the order as they fill, sorted there and
    settled with their place; so a task that runs again never deals a tie anew. What
    lies before a range follows from one count per range, and where a group begins from its least index.
    """
    group_by, order_by = list(group_by), list(order_by)
    rows = df.count()
    ranges = math.ceil(rows / rows_per_range)
    if ranges <= 1:
        own = Window.partitionBy(*(group_by or [F.lit(0)])).orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(own) - 1).cast("bigint"))
    full_order = group_by + [c for c in order_by if c not in group_by]
    placed = df.repartitionByRange(ranges, *full_order).sortWithinPartitions(*full_order)
    # The id is the number of the partition, and behind 33 bits that of the row in it.
    staged = settle(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    staged = staged.withColumn("_range", F.shiftright("_id", 33))
    counts = staged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(_before([])), F.lit(0)).alias("_rows_before"))
    # 16 bytes a range; beyond that many Spark joins as it sees fit.
    before = F.broadcast(before) if ranges <= BROADCAST_RANGES else before
    at = F.col("_rows_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    out = staged.join(before, "_range").withColumn(name, at)
    if group_by:
        first = out.groupBy(*group_by).agg(F.min(name).alias("_first"))
        out = _join_null_safe(out, first, group_by).withColumn(name, F.col(name) - F.col("_first"))
    return out.select(*[c for c in df.columns if c != name], name)


def grouped_parts(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    item: str,
    size: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Collect ``item`` per group in order, in parts of at most ``size`` items.

    A group of up to ``size`` items is one row (part 0). A larger group goes on in
    parts 1, 2, ...; ``parts`` says how many there are. Nothing is dropped, and no task
    holds a whole hot group.
    """
    ranked = dense_index(df, order_by, "_rank", group_by, rows_per_range)
    ranked = ranked.withColumn("part", F.floor(F.col("_rank") / size).cast("bigint"))
    packed = ranked.groupBy(*group_by, "part").agg(
        F.array_sort(F.collect_list(F.struct("_rank", F.col(item).alias("item")))).alias("_packed")
    )
    held = df.groupBy(*group_by).agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("parts"))
    return _join_null_safe(packed, held, list(group_by)).select(
        *group_by, "part", "parts", F.transform("_packed", lambda s: s["item"]).alias("items")
    )


def first_n(
    df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column], n: int,
    name: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1.

    A row among the first n of its group is among the first n of its salt bucket, so the
    buckets are cut first. A salt takes the rows of some input partitions, and there are
    about as many salts as partitions in a salt: with T tasks, the last one of a group that
    fills a third of the input sees n times the square root of T rows, not n times T.
    """
    salts = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if salts > 1:
        salted = df.withColumn("_salt", F.spark_partition_id() % salts)
        near = Window.partitionBy(*group_by, "_salt").orderBy(*order_by)
        df = (
            salted.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= n)
            .drop("_near", "_salt")
        )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group_by).orderBy(*order_by)))
    return ranked.where(F.col(name) <= n)
