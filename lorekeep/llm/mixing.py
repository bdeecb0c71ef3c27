"""Mix sources to target weights.

Documents of a source lie in blocks of a fixed permutation. How many blocks each
source gives, and how often, follows from the targets. A tree of multivariate
hypergeometric splits deals these quotas out among the output shards; a shard then
draws its disjoint range of the permuted blocks and shuffles its rows locally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Words that one block holds on average, and output shards are made for.
BLOCK_WORDS = 20_000
SHARD_WORDS = 2_000_000
#: No document and no source is taken more often than this.
MOST = 3
#: Most blocks that numpy splits in one draw.
DRAW = 10**9 - 1


def word_count(text: str = "text"):
    """Number of runs of anything but space and the ASCII controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the
    total; what goes beyond ``most`` times a source's size is shared again among
    the rest. Those cut off are the first in the order of size over weight, so one
    running sum finds them: source k is cut if its cap is at most its share of
    what the sources before it leave. Windows run over one row per source.
    """
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    weighed = weighed.withColumn("_cap", F.col("source_size").cast("double") * most).withColumn(
        "_total", F.sum("source_size").over(everything).cast("double"))
    by_cap = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("_w").over(after)
    cut = weighed.withColumn("_level", level).withColumn("_cut", F.col("_cap") <= F.col("_level") * F.col("_w"))
    # The level of the first source that is not cut holds for all of them.
    shared = F.min(F.when(~F.col("_cut"), F.struct((F.col("_cap") / F.col("_w")).alias("_o"),
                                                   F.col("_level").alias("_l")))).over(everything)
    return cut.withColumn("_share", shared).select(
        "source", "source_size",
        F.when(F.col("_cut"), F.col("_cap")).otherwise(F.col("_share._l") * F.col("_w")).alias("target"))


def drawn(have: np.ndarray, want: int, rng: np.random.Generator, most: int = DRAW) -> np.ndarray:
    """How many of ``want`` blocks, drawn from ``have`` of each source, come from each.

    More than ``most`` blocks are drawn in even strata of each source's blocks, one after the other.
    """
    total = int(have.sum())
    strata = -(-(total + len(have)) // most) if total > most else 1
    out, taken, passed = np.zeros_like(have), 0, 0
    for k in range(1, strata + 1):
        part = have * k // strata - have * (k - 1) // strata
        passed += int(part.sum())
        share = want * passed // max(1, total) - taken
        taken += share
        if share:
            out += rng.multivariate_hypergeometric(part, share, method="marginals")
    return out


def split_quotas(quotas: np.ndarray, shards: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source for shard ``leaf``, and the blocks of each that lie before them.

    Every node of the tree draws from its own seed, so all leaves see the same splits.
    """
    have, before, low, high, node = quotas.copy(), np.zeros_like(quotas), 0, shards, 1
    while high - low > 1:
        mid = (low + high) // 2
        total = int(have.sum())
        want = (total * (mid - low) + (high - low) // 2) // (high - low)
        rng = np.random.default_rng([seed, node])
        left = drawn(have, want, rng)
        if leaf < mid:
            have, high, node = left, mid, 2 * node
        else:
            have, before, low, node = have - left, before + left, mid, 2 * node + 1
    return have, before


def salt(seed: int) -> Column:
    """The hash ``mix_salt`` that gives a row its place in the permutation."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("mix_salt")


def mix_sources(
    docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most: int = MOST,
) -> DataFrame:
    """``docs`` repeated, or left out, so that each source comes near its target.

    Adds ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copy`` (from 0),
    ``mix_shard`` and ``mix_position`` (order inside the shard). A source below its
    target is taken whole as often as it fits; the rest comes block by block in
    permuted order, and row by row from the one block that does not fit whole, up to
    the row nearest the target. Equal rows count as rows of their own. Documents
    without words are never taken (a null text has none); a source without words has
    target 0; a null source is a source; an empty table gives an empty mix. The same
    rows give the same mix. Other columns pass through; those that are named like an
    added one are replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copy", "mix_shard", "mix_position"]
    names = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), word_count().alias("mix_size"), salt(seed))
    same = Window.partitionBy("mix_salt").orderBy("row.doc_id")
    slim = settle(rows.select("row.doc_id", "row.source", "mix_size", "mix_salt"), "mix-rows")
    nth = F.row_number().over(Window.partitionBy("mix_salt").orderBy("doc_id"))
    picks = mix_sized(slim.withColumn("_nth", nth), seed, block_words, shard_words, most).select(
        F.col("mix_salt").alias("_salt"), F.col("_nth").alias("_pick"), *added[1:])
    # Texts travel once, to be numbered among equal rows; a range as condition keeps them where they then are.
    whole = rows.withColumn("_nth", F.row_number().over(same))
    return whole.join(picks, F.expr("mix_salt = _salt and _nth >= _pick and _nth <= _pick")).select("row.*", *added)


def mix_sized(rows: DataFrame, seed: int, block_words: int, shard_words: int, most: int) -> DataFrame:
    """The mix of rows that have ``mix_size`` and ``mix_salt`` and no texts any more."""
    slim = settle(rows.select("source", "mix_size", "mix_salt"), "mix-sizes")
    targets = source_targets(slim.groupBy("source").agg(F.sum("mix_size").alias("source_size")), most)
    targets = settle(targets.withColumn(
        "_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")), "mix-targets")

    # Blocks: ranges of the hash, so of one permutation of the source's rows.
    hashed = F.shiftrightunsigned("mix_salt", 33)
    block = F.floor(hashed * F.col("_blocks") / F.lit(float(1 << 31))).cast("long")

    def placed(df: DataFrame) -> DataFrame:
        t = targets.select(F.col("source").alias("_src"), F.col("source_size").alias("mix_source_size"),
                           F.col("target").alias("mix_target"), "_blocks")
        return df.join(t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("_block", block)

    per_block = placed(slim).where("mix_size > 0").groupBy("source", "_block").agg(
        F.sum("mix_size").alias("_words"), F.first("mix_target").alias("mix_target"),
        F.first("mix_source_size").alias("mix_source_size"))
    passes = F.floor(F.col("mix_target") / F.col("mix_source_size")).cast("int")
    rest = F.col("mix_target") - passes * F.col("mix_source_size")
    run = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("_passes", passes).withColumn("_rest", rest).withColumn(
        "_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    copies = F.col("_passes") + F.when(F.col("_before") < F.col("_rest"), 1).otherwise(0)
    drawn = per_block.withColumn("_room", F.col("_rest") - F.col("_before")).withColumn("_copies", copies).withColumn(
        "_draw", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).where("_copies > 0")
    part = F.col("_draw") == F.col("_passes")
    order = Window.partitionBy("source").orderBy("_draw", "_block")
    drawn = settle(drawn.select(
        "source", "_block", "_draw", F.when(part & (F.col("_words") > F.col("_room")), F.col("_room")).alias("_room"),
        (F.row_number().over(order) - 1).cast("long").alias("_no")), "mix-blocks")

    # The splitting tree: one group of a row per source for each shard.
    quotas = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("_quota"))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"))
    shards = max(1, -(-int(total.first()["n"]) // shard_words))
    leaves = quotas.withColumn("_leaf", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def leaf_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        have, before = split_quotas(pdf["_quota"].to_numpy(np.int64), shards, int(pdf["_leaf"][0]), seed)
        return pd.DataFrame({"source": pdf["source"], "mix_shard": pdf["_leaf"].astype(np.int32),
                             "_from": before, "_n": have})

    ranges = leaves.groupBy("_leaf").applyInPandas(leaf_ranges, "source string, mix_shard int, _from long, _n long")
    ranges = ranges.where("_n > 0").select(
        F.col("source").alias("_src"), "mix_shard", F.explode(F.expr("sequence(_from, _from + _n - 1)")).alias("_i"))
    dealt = drawn.join(ranges, F.expr("source <=> _src and _no = _i")).select(
        F.col("_src").alias("_bsrc"), F.col("_block").alias("_bno"), "_draw", "_room", "mix_shard")

    # Rows join their blocks; in a block taken in part, a running sum finds the rows.
    found = placed(rows).where("mix_size > 0").join(
        dealt, F.col("source").eqNullSafe(F.col("_bsrc")) & (F.col("_block") == F.col("_bno")))
    inside = Window.partitionBy("_bsrc", "_bno", "_draw").orderBy("mix_salt", "doc_id")
    upto = F.sum("mix_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = upto - F.col("mix_size") / 2
    found = found.withColumn("_middle", middle).where("_room is null or _middle <= _room")
    local = Window.partitionBy("mix_shard").orderBy(F.xxhash64(F.lit(seed + 1), "mix_salt", "_draw"), "doc_id")
    return found.withColumn("mix_position", F.row_number().over(local)).withColumn(
        "mix_copy", F.col("_draw").cast("int")).drop(
        "_blocks", "_block", "_bsrc", "_bno", "_draw", "_room", "_middle")


def mix_digest(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per document: how many words the mix takes of it."""
    same = Window.partitionBy("doc_id", "mix_salt").orderBy(F.lit(0))
    rows = settle(docs.select("doc_id", "source", word_count().alias("mix_size"), salt(seed))
                  .withColumn("_nth", F.row_number().over(same)), "mix-rows")
    mixed = mix_sized(rows, seed, BLOCK_WORDS, SHARD_WORDS, MOST)
    taken = mixed.groupBy("doc_id", "mix_salt", "_nth").agg(F.sum("mix_size").alias("taken"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size")))
    targets = targets.withColumnRenamed("source", "_src")
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("mix_salt").alias("_k"), F.col("_nth").alias("_n"), "taken")
    found = rows.join(taken, F.expr("doc_id <=> _d and mix_salt = _k and _nth = _n"), "left").select(
        "doc_id", "source", F.col("mix_size").alias("size"), F.coalesce("taken", F.lit(0)).alias("taken"))
    return found.join(targets, F.col("source").eqNullSafe(F.col("_src"))).select(
        "doc_id", "size", "source_size", "target", "taken")
