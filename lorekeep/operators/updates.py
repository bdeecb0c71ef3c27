"""Incremental feed: what is pending, who wins, and how the corpus changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .ordering import keys_of, running_sum


def pending_files(
    listing: DataFrame, processed: DataFrame, last_file: str | None = None, file_col: str = "file"
) -> DataFrame:
    """Listed files that were not processed yet.

    With ``last_file`` only names strictly greater (string order) count. Without
    it a file that failed once is picked up again, however old its name is.
    """
    files = listing.select(file_col)
    if last_file is not None:
        files = files.where(F.col(file_col) > last_file)
    return files.distinct().join(keys_of(processed, file_col), file_col, "left_anti")


def changed_since(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows changed strictly after ``cutoff``."""
    return df.where(F.col(column) > F.lit(cutoff))


def latest_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row per key by ``order_by``; rows without a key are dropped.

    An aggregate, not a window: each map task keeps one row per key, so a key
    that holds a third of the feed costs one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    winner = F.max_by(F.struct(*rest), F.struct(*order_by))
    keyed = df.dropna(subset=list(key))
    return keyed.groupBy(*key).agg(winner.alias("_row")).select(*key, "_row.*").select(*df.columns)


def merge_maps_last_wins(
    entries: DataFrame, key: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Union of maps held as rows; on a clash the later part wins."""
    return latest_per_key(entries, key, order_by)


def _known(corpus: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Corpus rows with one of the keys. A small feed is broadcast (Spark checks its
    size), so that the corpus keys need not be shuffled at all.
    """
    return corpus.join(keys_of(keys, key), key, "left_semi")


def sync_tally(
    feed: DataFrame, corpus: DataFrame, file_col: str = "feed_file", key: str = "pmid"
) -> DataFrame:
    """Per file: ``updated`` = feed rows whose key is in the corpus, ``new`` = the rest.

    Rows are counted per (file, key) before the join, so a hot key does not skew it.
    """
    per_key = feed.groupBy(file_col, key).agg(F.count(F.lit(1)).alias("_rows"))
    known = keys_of(_known(corpus.select(key), per_key, key), key).withColumn("_known", F.lit(True))
    hit = F.col("_known").isNotNull()
    return per_key.join(known, key, "left").groupBy(file_col).agg(
        F.sum(F.when(hit, F.col("_rows")).otherwise(0)).alias("updated"),
        F.sum(F.when(hit, 0).otherwise(F.col("_rows"))).alias("new"),
    )


def running_totals(
    tally: DataFrame, file_col: str = "feed_file", seed_updated: int = 0, seed_new: int = 0,
    rows_per_range: int = 100_000,
) -> DataFrame:
    """Totals after each file, in file order, on top of the seeds of earlier runs."""
    summed = running_sum(
        settle(tally, "tally"), [file_col],
        {"total_updated": F.col("updated"), "total_new": F.col("new")},
        rows_per_range=rows_per_range,
    )
    return summed.withColumns({
        "total_updated": F.col("total_updated") + F.lit(seed_updated),
        "total_new": F.col("total_new") + F.lit(seed_new),
    })


def update_targets(
    corpus: DataFrame, latest: DataFrame, key: str = "pmid", domain: str = "domain",
    new_domain: str | None = None,
) -> DataFrame:
    """Winning feed rows with the one domain each of them goes to.

    A key stored in several domains is updated in the smallest domain name only.
    Unknown keys go to ``new_domain``; without one they are left out.
    """
    homes = _known(corpus.select(key, domain), latest, key).groupBy(key).agg(
        F.min(domain).alias(domain))
    if new_domain is None:
        return latest.join(homes, key)
    placed = latest.join(homes, key, "left")
    return placed.withColumn(domain, F.coalesce(F.col(domain), F.lit(new_domain)))


def merge_targets(
    corpus: DataFrame,
    targets: DataFrame,
    key: str = "pmid",
    domain: str = "domain",
    insert: bool = False,
    newer_by: Sequence[str] | None = None,
) -> DataFrame:
    """Corpus rows with the targets merged in by (domain, key), and a ``touched`` flag.

    ``corpus`` may be cut down to the domains of the targets. ``insert`` adds
    targets without a row. With ``newer_by`` (columns of both sides) a feed row
    never replaces a row written by a later feed row.
    """
    fields = [c for c in targets.columns if c not in (key, domain)]
    new = targets.select(key, domain, F.struct(*fields).alias("_new"))
    stored = corpus.withColumn("_stored", F.lit(True))
    joined = stored.join(new, [domain, key], "full" if insert else "left")
    touched = F.col("_new").isNotNull()
    if newer_by:
        before = F.struct(*[F.col(c) for c in newer_by])
        incoming = F.struct(*[F.col(f"_new.{c}") for c in newer_by])
        first_write = F.col("_stored").isNull() | F.col(newer_by[0]).isNull()
        touched = touched & (first_write | (incoming >= before))
    joined = joined.withColumn("touched", touched)

    def value(c: str):
        if c not in fields:
            return F.col(c)
        return F.when(F.col("touched"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in corpus.columns], "touched")


def apply_updates(
    corpus: DataFrame,
    latest: DataFrame,
    key: str = "pmid",
    domain: str = "domain",
    mode: str = "update_only",
    new_domain: str | None = None,
    newer_by: Sequence[str] | None = None,
) -> DataFrame:
    """The whole corpus after the update, with a ``touched`` flag.

    ``latest`` has one row per key. ``update_only`` leaves unknown keys out;
    ``upsert`` adds them under ``new_domain``.
    """
    inbox = inbox_of(mode, new_domain)
    targets = update_targets(corpus, latest, key, domain, inbox)
    return merge_targets(corpus, targets, key, domain, inbox is not None, newer_by)


def apply_updates_colocated(
    corpus: DataFrame, latest: DataFrame, key: str = "pmid", domain: str = "domain", mode: str = "update_only",
    new_domain: str | None = None, newer_by: Sequence[str] | None = None,
) -> DataFrame:
    """``apply_updates`` for a corpus whose rows lie by ``key``, such as a bucketed table.

    The home of a key is found by a window over the key, and the feed joins by the key alone, so both use
    the order in which the corpus lies and only ``latest`` is shuffled. Spark deals out a corpus of fewer
    buckets than ``spark.sql.shuffle.partitions`` anew, for the sake of more tasks. The result lies like
    the corpus; with ``upsert`` unknown keys are added.
    """
    inbox = inbox_of(mode, new_domain)
    fields = [c for c in latest.columns if c not in (key, domain)]
    new = latest.select(key, F.struct(*fields).alias("_new"))
    home = F.min(domain).over(Window.partitionBy(key))
    joined = corpus.withColumn("_home", home).join(new, key, "left")
    touched = F.col("_new").isNotNull() & (F.col(domain) == F.col("_home"))
    if newer_by:
        before = F.struct(*[F.col(c) for c in newer_by])
        incoming = F.struct(*[F.col(f"_new.{c}") for c in newer_by])
        touched = touched & (F.col(newer_by[0]).isNull() | (incoming >= before))
    joined = joined.withColumn("touched", F.coalesce(touched, F.lit(False)))

    def value(c: str):
        return F.when(F.col("touched"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)

    done = joined.select(*[value(c) for c in corpus.columns], "touched")
    if inbox is None:
        return done
    fresh = latest.join(corpus.select(key), key, "left_anti")
    named = {c: F.col(c) for c in latest.columns} | {domain: F.lit(inbox)}
    return done.unionByName(fresh.select(
        *[named.get(c, F.lit(None).cast(corpus.schema[c].dataType)).alias(c) for c in corpus.columns], F.lit(True).alias("touched")))


def inbox_of(mode: str, new_domain: str | None) -> str | None:
    """The domain for unknown keys: none when only known ones are updated."""
    if mode not in ("update_only", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "upsert" and not new_domain:
        raise ValueError("upsert needs new_domain")
    return new_domain if mode == "upsert" else None
