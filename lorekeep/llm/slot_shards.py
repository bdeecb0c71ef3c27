"""Shards by fixed virtual slots.

A record's hash names one of thousands of slots, for ever. Which shard a slot belongs to is
written in a versioned map: version 0 deals the slots out in turn, every later version holds only
the slots that move. Bytes are summed per slot, and a rebalance edits the map on these sums alone: it moves
single slots, or swaps two, from the fullest shard to the emptiest until they are near equal.
So records are never compared, and what moves is known slot by slot.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, work_dir

MAP = "version int, virtual_slot int, part int, shard int, bytes long, rows long"
#: (virtual slot, part); a slot has more parts than part 0 only if it is a hot one.
Slot = tuple[int, int]


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    slots: int = 8192
    #: A rebalance ends when the fullest shard lies above the emptiest by this share of a fair one.
    tolerance: float = 0.001
    #: A slot of several rows and over this share of a fair shard is dealt out in parts.
    hot: float = 0.05
    #: And so is one of more rows than one task should number.
    slot_rows: int = 2_000_000


SETTINGS = Settings()


def dealt(slots: Iterable[Slot], shards: int) -> dict[Slot, int]:
    """Version 0: slots in turn."""
    return {slot: (slot[0] + slot[1]) % shards for slot in slots}


def _edits(shard_of: dict[Slot, int], loads: dict[Slot, int], shards: Sequence[int], tolerance: float, into: int | None) -> dict[Slot, int]:
    held: dict[int, list[tuple[int, Slot]]] = {s: [] for s in shards}
    for slot, shard in shard_of.items():
        if loads.get(slot, 0) > 0:
            held[shard].append((loads[slot], slot))
    for of in held.values():
        of.sort()
    total = {s: sum(n for n, _ in of) for s, of in held.items()}
    open_, moves = list(shards), 0
    edits: dict[Slot, int] = {}

    def move(item: tuple[int, Slot], a: int, b: int) -> None:
        held[a].remove(item)
        held[b].insert(bisect_left(held[b], item), item)
        total[a] -= item[0]
        total[b] += item[0]
        edits[item[1]] = b

    while True:
        full = max(open_, key=lambda s: (total[s], -s))
        least = min(open_, key=lambda s: (total[s], s)) if into is None else into
        gap = total[full] - total[least]
        if gap <= max(1.0, tolerance * sum(total[s] for s in open_) / len(open_)):
            if len(open_) == len(shards) or not moves:
                return edits
            open_, moves = list(shards), 0  # those set aside may find a partner now
            continue
        # The move or swap that leaves the two closest: a difference of about half the gap.
        best: tuple | None = None

        def offer(give: tuple, take: tuple | None) -> None:
            nonlocal best
            change = give[0] - (take[0] if take else 0)
            if 0 < change < gap and (best is None or abs(gap - 2 * change) < best[0]):
                best = (abs(gap - 2 * change), give, take)

        gives, takes = held[full], held[least]
        for take in [None, *(takes if into is None else [])]:
            at = bisect_left(gives, (gap / 2 + (take[0] if take else 0),))
            for give in gives[max(0, at - 1):at + 1]:
                offer(give, take)
        if best is None:  # one slot fills it; the others go on without it
            open_.remove(full)
            continue
        moves += 1
        move(best[1], full, least)
        if best[2]:
            move(best[2], least, full)


def rebalanced(shard_of: dict[Slot, int], loads: dict[Slot, int], shards: int, tolerance: float) -> dict[Slot, int]:
    """The slots to move, with their new shard, until ``shards`` shards are near equal or no move helps."""
    edits = _edits(shard_of, loads, range(shards), tolerance, None)
    return {slot: s for slot, s in edits.items() if shard_of[slot] != s}


def grown(shard_of: dict[Slot, int], loads: dict[Slot, int], shards: int, tolerance: float) -> dict[Slot, int]:
    """The slots that one more shard (number ``shards``) takes from the fullest ones; none moves elsewhere."""
    return _edits(shard_of, loads, range(shards + 1), tolerance, shards)


def write_version(spark: SparkSession, path: str, version: int, shards: dict[Slot, int], loads: dict[Slot, tuple[int, int]]) -> None:
    """Append a version of the map: all slots, or those that move. ``loads`` has bytes and rows."""
    rows = [(version, v, p, s, *loads.get((v, p), (0, 0))) for (v, p), s in sorted(shards.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Slot, part and shard as of ``version`` (the last one if None): each slot's latest edit."""
    edits = spark.read.schema(MAP).parquet(path)
    if version is not None:
        edits = edits.where(F.col("version") <= version)
    return edits.groupBy("virtual_slot", "part").agg(F.max_by("shard", "version").alias("shard"))


def _loads(df: DataFrame) -> dict[Slot, tuple[int, int]]:
    found = df.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {(r["virtual_slot"], r["part"]): (r["bytes"], r["n"]) for r in found.collect()}  # a row per slot and part


def shard_records(df: DataFrame, size: Column, key: Sequence[str], settings: Settings = SETTINGS, map_path: str | None = None) -> DataFrame:
    """``df`` with ``size``, ``virtual_slot``, ``shard`` and ``slot`` (the place in the shard, gapless from 0).

    ``key`` names the columns whose hash is the slot. Rows are settled once and shuffled once,
    by slot, so give only the columns to keep. The map is written to ``map_path`` as versions 0 and 1.
    Rows of equal keys lie in one slot, but for a hot slot: its rows are dealt over parts
    that the map lists one by one, so a third of all rows under one key still spread evenly, and
    nothing is numbered in one task. Null keys hash like any value, a null size counts as 0, rows that
    repeat all count; an empty table gives no rows. An input column named like a result is replaced.
    """
    s, spark = settings, df.sparkSession
    made = ("size", "virtual_slot", "part", "shard", "slot", "lk_row", "lk_before")
    held = [c for c in df.columns if c.lower() not in made]
    slim = df.select(
        *[F.col(f"`{c}`") for c in held], F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(s.slots)).cast("int").alias("virtual_slot"),
        F.lit(0).alias("part"), F.monotonically_increasing_id().alias("lk_row"))
    slim = settle(slim, "slots")
    whole = _loads(slim)
    fair = max(1, sum(b for b, _ in whole.values()) / s.shards * s.hot)
    parts = {v: n for (v, _), (b, rows) in whole.items()
             if (n := min(rows, int(max(b // fair, rows // s.slot_rows)) + 1)) > 1}
    loads = whole
    if parts:
        of = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("virtual_slot"))
        part = F.pmod(F.xxhash64("lk_row"), F.coalesce(of, F.lit(1))).cast("int")
        slim = slim.withColumn("part", part)
        loads = _loads(slim)
    first = dealt([*loads, *((v, 0) for v in range(s.slots) if (v, 0) not in loads)], s.shards)
    edits = rebalanced(first, {k: b for k, (b, _) in loads.items()}, s.shards, s.tolerance)
    path = map_path or work_dir(spark, "slot-map")
    write_version(spark, path, 0, first, loads)
    write_version(spark, path, 1, edits, loads)
    # The offsets follow the same map; it has a row per slot and part, so the broadcast is bounded.
    before: dict[int, int] = {}
    rows = []
    for slot, shard in sorted((first | edits).items()):
        rows.append((*slot, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + loads.get(slot, (0, 0))[1]
    offsets = spark.createDataFrame(rows, "virtual_slot int, part int, lk_before long")
    placed = F.broadcast(read_map(spark, path, 1).join(offsets, ["virtual_slot", "part"]))
    own = Window.partitionBy("virtual_slot", "part").orderBy(*[F.col(f"`{c}`") for c in key], "lk_row")
    return (slim.withColumn("lk_nth", F.row_number().over(own)).join(placed, ["virtual_slot", "part"])
            .select(*held, "size", "virtual_slot", "shard", (F.col("lk_before") + F.col("lk_nth") - 1).alias("slot")))


def shard_digest(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Every document's shard under law ``bytes``; the slot is hashed from doc_id, size and checksum."""
    slim = df.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("text_bytes"),
                     F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    done = shard_records(slim, F.col("text_bytes"), ["doc_id", "text_bytes", "text_crc32"], settings)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
