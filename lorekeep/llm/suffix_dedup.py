"""Remove passages that repeat anywhere in a collection, by suffix arrays built column by column.

A repeat is a string of ``window`` bytes. Its anchor, the least hashed gram in it, depends
on its bytes only, so equal windows meet under equal anchors: neighbouring windows with
one anchor form a segment, and segments are grouped by anchor. Segments whose anchor
occurs once are done. Equal segments are counted; among different ones of one anchor a
generalised suffix array finds the windows that they share. It is built as a
Burrows-Wheeler transform grows: each round puts one more symbol of every segment, from
its end on, into the sorted runs of suffixes and common prefixes, which are only ever
read and rewritten in sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove, settle, settled, sweep
from .common import shuffle_width, slices


@dataclass(frozen=True)
class Settings:
    """Lengths in bytes, and bounds on what a task holds."""

    window: int = 200
    gram: int = 32
    #: Bytes of a symbol: anchored segments line up, so whole words can be compared at once.
    symbol: int = 8
    #: Segments of one anchor that are sorted together; larger groups compare window by window.
    group: int = 20_000
    #: Bytes of segments in one collection.
    collection: int = 4 << 20
    #: Entries of a run that are read and rewritten at a time.
    block: int = 1 << 18
    #: Most bits (a power of two of them) of a filter that spares unrepeated anchors the way to disk.
    filter_bits: int = 28
    #: Segments whose bytes a task remembers having written.
    remembered: int = 100_000


SETTINGS = Settings()

#: Bits of one of Spark's bitmaps (4 KB).
PART_BITS = 1 << 15


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin and end."""
    col = pc.fill_null(batch.column(column), "")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each place."""
    h = np.random.default_rng(10).integers(0, 1 << 63, 256, np.uint64)[flat]
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def least_places(grams: np.ndarray, width: int, stretch: int = 1 << 22) -> np.ndarray:
    """The place of the leftmost least of each ``width`` neighbouring grams.

    A number holds the upper 40 bits of a hash and a place in 24 bits, so places are
    counted from the begin of a stretch of at most 2 ** 24 grams; stretches overlap by ``width - 1``.
    """
    many = len(grams) - width + 1
    out, step = np.empty(many, np.int64), stretch - width + 1
    for at in range(0, many, step):
        part = grams[at:at + stretch]
        least, have = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            rest = width - have
            least = np.minimum(least[:-rest], least[rest:])
        out[at:at + step] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    return out


def segments(flat: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, anchor place, anchor hash) of each segment.

    The anchor of a window is the leftmost of its least grams.
    """
    if len(flat) < s.window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    grams = gram_hashes(flat, s.gram)
    anchor = least_places(grams, s.window - s.gram + 1)
    valid = np.zeros(len(anchor), bool)
    for a, b in zip(ends[:-1], ends[1:]):
        valid[a:max(a, b - s.window + 1)] = True
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    row = np.searchsorted(ends, first, "right") - 1
    return row, first, stop - first, anchor[first], grams[anchor[first]]


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "text", 1 << 20)


def anchor_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(anchor, many): anchors of more than one segment, and whether these differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            flat, ends = text_bytes(batch)
            _, first, n, _, anchor = segments(flat, ends, s)
            view = memoryview(flat)
            body = np.array([xxhash.xxh3_64_intdigest(view[a:a + k + s.window - 1]) for a, k in zip(first.tolist(), n.tolist())],
                            np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64))],
                                             names=["anchor", "body"])

    seen = docs.select("text").mapInArrow(run, "anchor long, body long")
    return seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("lo"), F.max("body").alias("hi")).where(
        "n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("many"))


def filter_of(anchors: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """A bitmap with a bit for each anchor, as 64-bit words, and the power of two that it holds.

    There are 16 bits or more for each anchor, as long as that is no more than 2 ** ``most``. The place is the
    low end of the hash: anchors are the least of many, so their high bits are mostly zeros. The tasks set the
    bits; the driver gets the bitmap in parts of 4 KB, however many anchors there are.
    """
    bits = min(most, max(16, anchors.count().bit_length() + 4))
    at = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark counts the bits of its bitmaps from 1
    places = anchors.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
    # The bits of a part meet before they are set, so that no task writes out parts for others to merge.
    parts = places.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap, size = np.zeros(1 << (bits - 6), np.uint64), PART_BITS >> 6
    for part, held in parts.collect():  # at most 2 ** (bits - 15) rows
        bitmap[(part - 1) * size:part * size] = np.frombuffer(held, "<u8")[:len(bitmap)]
    return bitmap, bits


def passes(bitmap: np.ndarray, bits: int, anchor: np.ndarray) -> np.ndarray:
    at = anchor & np.uint64((1 << bits) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


OCCURRENCE = (
    "doc_id long, text_key long, start int, windows int, lead int, anchor long, s1 long, s2 long, body binary"
)


def occurrences(docs: DataFrame, anchors: DataFrame, s: Settings) -> DataFrame:
    """Segments whose anchor occurs again. If segments of the anchor differ, a task adds the
    bytes of a segment where it meets it first. They lie by anchor, so like bytes are neighbours on disk.
    """
    context = docs.sparkSession.sparkContext
    held = context.broadcast((filter_of(anchors, s.filter_bits), filter_of(anchors.where("many"), s.filter_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, many = held.value
        seen: set[int] = set()
        for batch in slices_of(batches):
            flat, ends = text_bytes(batch)
            row, first, n, place, anchor = segments(flat, ends, s)
            keep = passes(*again, anchor)
            row, first, n, place, anchor = (x[keep] for x in (row, first, n, place, anchor))
            view = memoryview(flat)
            digests, bodies = [], []
            for a, k, p in zip(first.tolist(), n.tolist(), passes(*many, anchor).tolist()):
                body = view[a:a + k + s.window - 1]
                digest = xxhash.xxh3_128_intdigest(body)
                digests.append(divmod(digest, 1 << 64))
                if p and digest not in seen:
                    if len(seen) >= s.remembered:
                        seen.clear()
                    seen.add(digest)
                    bodies.append(bytes(body))
                else:
                    bodies.append(None)
            halves = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)),
                pa.array((first - ends[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array((place - first).astype(np.int32)), pa.array(anchor.view(np.int64)),
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bodies, pa.binary()),
            ], names=["doc_id", "text_key", "start", "windows", "lead", "anchor", "s1", "s2", "body"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, OCCURRENCE).join(anchors, "anchor")


class Run:
    """Sorted suffixes as sequential blocks of (symbol, place of the rest, own number, common prefix).

    ``place of the rest`` is where the suffix without its first symbol lies in the order,
    so (symbol, place) is the order itself. A round reads the blocks once, in order, and
    writes them again with the new suffixes between.
    """

    def __init__(self, block: int):
        self.block = block
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def insert(self, key: np.ndarray, number: np.ndarray, shared, empty: int) -> np.ndarray:
        """Put in suffixes with ascending ``key`` = symbol << 32 | place; returns their places.

        ``shared(a, b)`` gives the common prefixes of suffixes by number.
        """
        ins, base = np.empty(len(key), np.int64), 0
        tops = [b[0][-1] for b in self.blocks]
        cuts = [0, *(np.searchsorted(key, t, "left") for t in tops[:-1]), len(key)] if tops else [0, len(key)]
        sources = self.blocks or [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8))]
        for (keys, *_), a, b in zip(sources, cuts, cuts[1:]):
            ins[a:b] = base + np.searchsorted(keys, key[a:b])
            base += len(keys)
        # Where the rest of a suffix lies moves by the suffixes put in before it.
        def moved(k: np.ndarray) -> np.ndarray:
            place = (k & 0xFFFFFFFF) - empty
            return k + np.where(place >= 0, np.searchsorted(ins, place, "right"), 0)

        out, base, last = [], 0, None
        for (keys, numbers, lcps), a, b in zip(sources, cuts, cuts[1:]):
            at = ins[a:b] - base
            new_keys = np.insert(moved(keys), at, moved(key[a:b]))
            new_numbers = np.insert(numbers, at, number[a:b])
            fresh = np.zeros(len(keys) + 1, bool)
            fresh[at] = True
            new_lcps = np.insert(lcps, at, 0)
            mine = at + np.arange(len(at))
            touched = np.union1d(mine, np.minimum(mine + 1, len(new_keys) - 1)) if len(at) else np.zeros(0, np.int64)
            if len(new_keys) and last is not None:
                touched = np.union1d(touched, [0])
            inner = touched[touched > 0]
            new_lcps[inner] = shared(new_numbers[inner - 1], new_numbers[inner])
            if len(new_keys) and last is not None:
                new_lcps[0] = shared(np.array([last]), new_numbers[:1])[0]
            if len(new_keys):
                last = new_numbers[-1]
            base += len(keys)
            for i in range(0, len(new_keys), self.block):
                out.append((new_keys[i:i + self.block], new_numbers[i:i + self.block], new_lcps[i:i + self.block]))
        self.blocks, self.size = out, self.size + len(key)
        return empty + ins + np.arange(len(key))


def shared_windows(bodies: list[bytes], leads: np.ndarray, s: Settings) -> list[np.ndarray]:
    """For each segment, the windows that another segment of the collection has as well.

    Symbols are counted from the anchor, so equal windows have equal symbols in equal
    places. A window holds ``window // symbol - 1`` whole symbols, which must be a common
    prefix in the suffix array, and ``symbol`` more bytes around them, which are compared as one number.
    """
    size, inner = s.symbol, s.window // s.symbol - 1
    lengths = np.array([len(b) for b in bodies], np.int64)
    skip = leads % size
    counts = (lengths - skip) // size
    flat = np.frombuffer(b"\0" * size + b"".join(bodies) + b"\0" * (2 * size), np.uint8)
    offsets = size + np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(bodies)), counts)
    starts = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(starts[-1]) - starts[owner]
    at = offsets[owner] + skip[owner] + size * index

    def number_at(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for i in range(size):
            out = out << np.uint64(8) | flat[places + i].astype(np.uint64)
        return out

    _, codes = np.unique(number_at(at), return_inverse=True)
    codes = np.append(codes.astype(np.int64) + 1, 0)  # 0: nothing follows
    after = np.append(counts[owner] - index, 0)  # symbols from here to the segment's end

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix in symbols, up to ``inner``."""
        most = np.minimum(np.minimum(after[a], after[b]), inner)
        out, live = np.zeros(len(a), np.int8), np.arange(len(a))
        for k in range(inner):
            live = live[most[live] > k]
            live = live[codes[a[live] + k] == codes[b[live] + k]]
            if not len(live):
                break
            out[live] += 1
        return out

    run, place = Run(s.block), np.arange(len(bodies), dtype=np.int64)
    for r in range(1, int(counts.max(initial=0)) + 1):
        live = np.flatnonzero(counts >= r)
        number = starts[live] + counts[live] - r
        key = codes[number] << 32 | place[live]
        order = np.argsort(key, kind="stable")
        place[live[order]] = run.insert(key[order], number[order].astype(np.int32), shared, len(bodies))

    if not run.blocks:
        return [np.zeros(0, np.int64)] * len(bodies)
    numbers = np.concatenate([b[1] for b in run.blocks]).astype(np.int64)
    lcps = np.concatenate([b[2] for b in run.blocks])
    class_of = np.cumsum(lcps < inner)
    grouped = lcps >= inner
    grouped[:-1] |= lcps[1:] >= inner
    numbers, class_of = numbers[grouped], class_of[grouped]
    base = at[numbers] - offsets[owner[numbers]]
    before, behind = number_at(at[numbers] - size), number_at(np.minimum(at[numbers] + size * inner, len(flat) - size))
    hits_owner, hits_window = [], []
    for d in range(size):
        window = base - d
        fit = np.flatnonzero((window >= 0) & (window + s.window <= lengths[owner[numbers]]))
        left = before[fit] & np.uint64((1 << 8 * d) - 1)
        around = left << np.uint64(8 * (size - d)) | behind[fit] >> np.uint64(8 * d) if d else behind[fit]
        order = np.lexsort((around, class_of[fit]))
        same = (around[order][1:] == around[order][:-1]) & (class_of[fit][order][1:] == class_of[fit][order][:-1])
        hit = np.zeros(len(fit), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hits_owner.append(owner[numbers[fit[hit]]])
        hits_window.append(window[fit[hit]])
    who, window = np.concatenate(hits_owner), np.concatenate(hits_window)
    order = np.lexsort((window, who))
    who, window = who[order], window[order]
    return np.split(window, np.searchsorted(who, np.arange(1, len(bodies))))


def runs_of(windows: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.append(0, cut + 1)].tolist(), windows[np.append(cut, len(windows) - 1)].tolist()))


SPAN = "doc_id long, text_key long, lo long, hi long"
SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def collection_spans(different: DataFrame, s: Settings) -> DataFrame:
    """Spans of segments that occur once and share windows with others of their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None

        def solve():
            found = shared_windows([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), s)
            spans = [(r[3], r[4], r[5] + a, r[5] + b + s.window)
                     for r, own in zip(rows, found) if r[6] == 1 for a, b in runs_of(own)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in spans], pa.int64()) for i in range(4)], schema=SPAN_ARROW)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "body", "lead", "doc_id", "text_key", "start", "n")]
            for row in zip(*cols):
                if held >= s.collection and row[0] != last:
                    yield solve()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[1])
                last = row[0]
        if rows:
            yield solve()

    dealt = different.repartition(shuffle_width(different), "anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "body", "lead", "doc_id", "text_key", "start", "n").mapInArrow(run, SPAN)


def window_spans(different: DataFrame, s: Settings) -> DataFrame:
    """The same for anchors of very many segments: windows are counted by their hashes, before and after the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, start, n, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "n", "body"))):
                view = memoryview(body)
                for w in range(len(body) - s.window + 1):
                    out.append((doc, key, start + w, n, xxhash.xxh3_128_digest(view[w:w + s.window])))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["doc_id", "text_key", "lo", "n", "hash"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    windows = settle(different.select("doc_id", "text_key", "start", "n", "body").mapInArrow(
        run, "doc_id long, text_key long, lo long, n long, hash binary"), "windows")
    again = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("hash")
    return windows.where("n = 1").join(again, "hash").select("doc_id", "text_key", "lo", (F.col("lo") + s.window).alias("hi"))


def repeated_spans(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(doc_id, text_key, lo, hi): byte spans, which may overlap, that cover all repeated windows.

    Bytes of segments are written once by each task that meets them, move to meet their equals,
    and once more, one of each, to their anchor. The tables on the way go as soon as the spans are there.
    """
    spark = docs.sparkSession
    before = settled(spark)
    anchors = settle(anchor_counts(docs, s), "anchors")
    found = settle(occurrences(docs, anchors, s), "occurrences")
    sweep(spark)
    lone = F.struct(F.col("body").isNotNull().alias("b"), "doc_id", "text_key", "start")
    same = found.groupBy("anchor", "s1", "s2").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("body", "lead", "doc_id", "text_key", "start"), lone).alias("_r"),
        F.max("many").alias("many"))
    same = settle(same.where("n > 1 or many").select("anchor", "s1", "s2", "n", "many", "_r.*"), "segments")
    sweep(spark)
    copied = found.join(same.where("n > 1").select("anchor", "s1", "s2"), ["anchor", "s1", "s2"]).select(
        "doc_id", "text_key", F.col("start").cast("long").alias("lo"),
        (F.col("start") + F.col("windows") + (s.window - 1)).cast("long").alias("hi"))
    different = same.where("many")
    # At most a row for every ``group`` segments; settled, so that Spark knows its size before it plans the joins.
    large = settle(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > s.group).select("anchor"), "large")
    if large.isEmpty():
        spans = copied.unionByName(collection_spans(different, s))
    else:
        spans = copied.unionByName(collection_spans(different.join(large, "anchor", "left_anti"), s))
        spans = spans.unionByName(window_spans(different.join(large, "anchor", "left_semi"), s))
    spans = settle(spans, "spans")
    sweep(spark)
    for path in settled(spark) - before:
        if "/spans-" not in path:
            remove(spark, path)
    return spans


def remove_repeats(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``docs`` with a struct ``repeats``: n_bytes, n_removed, n_spans, the spans, the bytes that are left, and ``text``.

    The last is null if nothing goes, else what is left without the characters that a cut runs through.

    Every byte under a string of ``window`` bytes that also starts elsewhere goes, in all
    its places, same document or not. Null and empty texts, and those shorter than a
    window, lose nothing. Rows with equal doc_id and text count as different places of
    the text. A null doc_id is an id of its own. Other columns pass through, whatever their
    names; one named ``repeats`` is replaced and one named ``text_key`` left out. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("repeats", "text_key")]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("text_key"))
    spans = repeated_spans(kept.select("row.doc_id", "text_key", "row.text"), s)
    own = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select(
        F.col("doc_id").alias("own_doc"), F.col("text_key").alias("own_key"), "spans")
    rows = kept.join(own, F.col("row.doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_key") == F.col("own_key")), "left")
    rows = rows.select("row", F.col("row.text").alias("text"), "spans")
    result = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))),
        T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType()),
    ])
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                      ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, merged, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], [], 0
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                for lo, hi in merged:
                    parts.append(raw[at:lo])
                    at = hi
                parts.append(raw[at:])
                left = b"".join(parts)
                out.append({"n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(merged),
                            "spans": [{"lo": a, "hi": b} for a, b in merged], "kept": left,
                            "text": "".join(p.decode("utf-8", "ignore") for p in parts) if merged else None})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], names=["row", "repeats"])

    done = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("repeats", result)]))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "repeats")


def repeats_digest(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """One row per document."""
    r = F.col("repeats")
    return remove_repeats(docs.select("doc_id", "text"), s).select(
        "doc_id", r.n_bytes.alias("n_bytes"), r.n_removed.alias("n_removed"), r.n_spans.alias("n_spans"),
        F.sha2(r.kept, 256).alias("kept_sha256"))
