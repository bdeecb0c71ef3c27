"""Two large sides compared by digests of key ranges.

Each side is reduced to a row per range of the key's hash: the number of its rows, and what their hashes
come to by exclusive-or and by sum. Ranges whose digests are equal hold the same rows, with the
same repeats, so nothing is missing there; only rows of the other ranges go into a shuffle. Two catalogs that
hardly differ are compared by reading each twice and moving little. Digests are sums, so a key that
holds a third of a side is a number like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import keys_of
from .reconcile import missing_names, missing_tags

#: Ranges of the hash; the driver holds the numbers of those that differ, in 8 KB.
RANGES = 4096


def range_of(key: str, ranges: int = RANGES) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int")


def range_digests(df: DataFrame, key: str, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(range, n, x, s, nulls): rows, the exclusive-or and the sum of two hashes of ``columns``, rows with a null.

    The sum tells repeats apart, which cancel in the exclusive-or.
    """
    cells = [F.col(name) for name in columns]
    null = reduce(lambda a, b: a | b, (c.isNull() for c in cells))
    other = F.pmod(F.xxhash64(F.lit(31), *cells), F.lit(1 << 40)).cast("decimal(38,0)")
    return df.groupBy(range_of(key, ranges).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cells)).alias("x"), F.sum(other).alias("s"), F.count_if(null).alias("nulls"))


def differing_ranges(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], ranges: int = RANGES) -> list[int]:
    """The ranges of ``old`` whose rows are not those of ``new``. A range that ``old`` lacks has nothing to miss.

    A null equals nothing, as in a join, so a range with one always differs.
    """
    theirs = range_digests(new, key, columns, ranges).select("range", F.struct("n", "x", "s").alias("theirs"))
    both = range_digests(old, key, columns, ranges).join(theirs, "range", "left")
    odd = both.where((F.col("nulls") > 0) | ~F.struct("n", "x", "s").eqNullSafe(F.col("theirs")))
    return sorted(r[0] for r in odd.select("range").collect())  # at most ``ranges`` numbers


def in_ranges(df: DataFrame, key: str, wanted: Sequence[int], ranges: int = RANGES) -> DataFrame:
    """The rows of these ranges, chosen where they are read."""
    if len(wanted) == ranges:
        return df
    return df.where(range_of(key, ranges).isin(list(wanted))) if wanted else df.where(F.lit(False))


def missing_names_by_digest(old: DataFrame, new: DataFrame, name: str = "name", ranges: int = RANGES) -> DataFrame:
    """As ``reconcile.missing_names``, by shuffling only the ranges that differ."""
    wanted = differing_ranges(old, new, name, [name], ranges)
    return missing_names(in_ranges(old, name, wanted, ranges), in_ranges(new, name, wanted, ranges), name)


def missing_tags_by_digest(
    old: DataFrame, new: DataFrame, pkg: str = "name", tag: str = "tag", ranges: int = RANGES,
) -> DataFrame:
    """As ``reconcile.missing_tags`` for packages on both sides. Ranges are those of packages, so all of a package lies in one."""
    wanted = differing_ranges(old, new, pkg, [pkg, tag], ranges)
    old, new = in_ranges(old, pkg, wanted, ranges), in_ranges(new, pkg, wanted, ranges)
    return missing_tags(old, new, keys_of(new, pkg), pkg, tag)


def summary_by_digest(old: DataFrame, new: DataFrame, pkg: str = "name", tag: str = "tag", ranges: int = RANGES) -> DataFrame:
    """As ``reconcile.reconcile_summary`` over (package, tag) rows: one row of counts, and the verdict.

    Where the sides are equal, packages are counted once for both; only in the other ranges do they meet.
    """
    wanted = differing_ranges(old, new, pkg, [pkg, tag], ranges)
    there = F.lit(False) if not wanted else range_of(pkg, ranges).isin(wanted)
    alike = keys_of(old.where(~there), pkg).select(F.lit(1).alias("o"), F.lit(1).alias("n"), F.lit(0).alias("g"))
    mine = keys_of(in_ranges(old, pkg, wanted, ranges), pkg).withColumn("o", F.lit(1))
    theirs = keys_of(in_ranges(new, pkg, wanted, ranges), pkg).withColumn("n", F.lit(1))
    lost = missing_tags(in_ranges(old, pkg, wanted, ranges), in_ranges(new, pkg, wanted, ranges), mine, pkg, tag)
    gaps = keys_of(lost, pkg).withColumn("g", F.lit(1))
    odd = mine.join(theirs, pkg, "full").join(gaps, pkg, "left").select(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("o", "n", "g")])
    # New packages of ranges that the old side lacks altogether are counted as well.
    rest = new.where(~there).join(_ranges_held(old, pkg, ranges), range_of(pkg, ranges) == F.col("held"), "left_anti")
    rest = keys_of(rest, pkg).select(F.lit(0).alias("o"), F.lit(1).alias("n"), F.lit(0).alias("g"))
    counted = alike.unionByName(odd).unionByName(rest).agg(
        F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("old_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("new_count"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("missing_names"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("checked"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 1) & (F.col("g") == 1)).alias("with_missing_tags"))
    clean = (F.col("missing_names") == 0) & (F.col("with_missing_tags") == 0)
    return counted.withColumn("verdict", F.when(clean, "complete").otherwise("incomplete"))


def _ranges_held(df: DataFrame, key: str, ranges: int) -> DataFrame:
    return df.select(range_of(key, ranges).alias("held")).distinct()
