"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary goes into blocked Bloom filters, one per word length, that are broadcast. Every word
probes them with its edits (its deletions, and its replacements by a greater code point, so each
pair of near words is met from one side only); the hash of an edit follows from the word's by a few
exclusive-ors. Only edits that a filter knows become rows, and an exact join with the vocabulary
drops those it knows by mistake.

The filters hold at most ``pass_bytes`` at a time. A larger vocabulary takes more passes,
each with a stretch of the filters and the lengths that fall into it; the rows are the same.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import shuffle_width, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: What a lower-cased run can hold.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    drop_every: int = 97
    least_length: int = 5
    least_count: int = 3
    #: A variant's form occurs at least this many times as often.
    lead: int = 2
    bits_a_word: int = 20
    #: Most bytes of filters that are broadcast at a time.
    pass_bytes: int = 32 << 20
    #: Words of this length and more share a filter.
    long_words: int = 64
    #: Probes and words that a task holds at a time.
    probes: int = 1 << 20
    words: int = 200_000


SETTINGS = Settings()


def _edited(doc_id: str, run: str, every: int) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts; words of enough length and occurrences only.

    Whole texts count, repeated rows each time. A null text has no words; a null id is written as
    nothing before the colon. Tasks add up as they read, so a frequent word is a few rows of each task.
    """
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            texts = pc.ascii_lower(batch.column("text")).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                name = "" if doc_id is None else str(doc_id)
                for found, n in Counter(RUN.findall(text or "")).items():
                    if len(found) >= s.least_length:
                        word = _edited(name, found, s.drop_every)
                        if len(word) >= s.least_length:
                            held[word] += n
            if len(held) >= s.words:
                yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.least_count)


def mixed(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64 bits for a code point at a place; a word's hash is the exclusive-or of its code points'."""
    x = place.astype(np.uint64) * np.uint64(0x10001) + code.astype(np.uint64) * MIX[0] + MIX[2]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def bits_of(h: np.ndarray) -> np.ndarray:
    """Five of the 64 bits of a block."""
    one, low = np.uint64(1), np.uint64(63)
    out = one << (h & low)
    for shift in (6, 12, 18, 24):
        out |= one << ((h >> np.uint64(shift)) & low)
    return out


@dataclass(frozen=True)
class Layout:
    """Where the filter of each length begins, in blocks of 64 bits, and how long it is."""

    first: dict[int, int]
    blocks: dict[int, int]
    total: int
    longest: int

    @classmethod
    def of(cls, counts: dict[int, int], settings: Settings) -> Layout:
        first, blocks, at = {}, {}, 0
        for length in sorted(counts):
            # Places within a filter have 32 bits.
            first[length], blocks[length] = at, min((1 << 32) - 1, counts[length] * settings.bits_a_word // 64 + 1)
            at += blocks[length]
        return cls(first, blocks, at, settings.long_words)

    def kind(self, length: int) -> int:
        return min(length, self.longest)

    def touches(self, length: int, lo: int, hi: int) -> bool:
        kind = self.kind(length)
        return kind in self.first and self.first[kind] < hi and lo < self.first[kind] + self.blocks[kind]


def by_length(words: list[str], most: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of ``words`` of equal length, at most about ``most`` code points at a time, as a matrix."""
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for length, rows in of.items():
        step = max(1, most // length)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            data = "".join(words[i] for i in part).encode("utf-32-le")
            yield part, np.frombuffer(data, np.uint32).reshape(len(part), length).astype(np.uint64)


def build(vocabulary: DataFrame, layout: Layout, lo: int, hi: int, page: int = 8192) -> np.ndarray:
    """The blocks from ``lo`` to ``hi`` with the words of ``vocabulary`` set."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            places, bits = [], []
            for rows, m in by_length(words, 1 << 20):
                kind = layout.kind(m.shape[1])
                h = finished(np.bitwise_xor.reduce(mixed(np.arange(m.shape[1])[None, :], m), axis=1))
                places.append(block_of(h, layout.blocks[kind]).astype(np.int64) + layout.first[kind])
                bits.append(bits_of(h).view(np.int64))
            if places:
                place, bit = np.concatenate(places), np.concatenate(bits)
                mine = (place >= lo) & (place < hi)
                place, bit = place[mine], bit[mine]
                yield pa.RecordBatch.from_arrays([pa.array((place - lo) // page), pa.array((place - lo) % page), pa.array(bit)],
                                                 names=["page", "at", "bits"])

    def paged(table: pa.Table) -> pa.Table:
        out = np.zeros(page, np.uint64)
        np.bitwise_or.at(out, table["at"].to_numpy(), table["bits"].to_numpy().view(np.uint64))
        return pa.table({"page": table["page"][:1], "blocks": pa.array([out.tobytes()], pa.binary())})

    rows = vocabulary.select("word").mapInArrow(hashed, "page long, at long, bits long")
    out = np.zeros(-(-(hi - lo) // page) * page, np.uint64)
    # At most pass_bytes in all, a page a row.
    for r in rows.groupBy("page").applyInArrow(paged, "page long, blocks binary").toLocalIterator():
        out[r["page"] * page:(r["page"] + 1) * page] = np.frombuffer(r["blocks"], np.uint64)
    return out[:hi - lo]


def probe(words: list[str], layout: Layout, blocks: np.ndarray, lo: int, hi: int, most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows of ``words``, edits that the filters know), for edits whose place lies in the stretch."""

    def known(h: np.ndarray, kind: int) -> np.ndarray:
        h = finished(h)
        place = block_of(h, layout.blocks[kind]).astype(np.int64) + (layout.first[kind] - lo)
        there = (place >= 0) & (place < hi - lo)
        bits = bits_of(h)
        return np.flatnonzero(there & ((blocks[np.where(there, place, 0)] & bits) == bits))

    for rows, m in by_length(words, max(1, most // len(ALPHABET))):
        n, length = m.shape
        at = np.arange(length)[None, :]
        own = mixed(at, m)
        full = np.bitwise_xor.reduce(own, axis=1)
        ids = np.array(rows)
        if layout.touches(length, lo, hi):
            # Long words in stretches of places, so that the probes stay few at a time.
            step = max(1, most // (n * len(ALPHABET)))
            for start in range(0, length, step):
                cut = slice(start, min(length, start + step))
                old = m[:, cut]
                rest = full[:, None] ^ own[:, cut]
                i, p, a = np.nonzero(old[:, :, None] < ALPHABET)
                h = rest[i, p] ^ mixed(p + start, ALPHABET[a])
                hit = known(h, layout.kind(length))
                yield ids[i[hit]], [
                    words[rows[r]][:q] + chr(c) + words[rows[r]][q + 1:]
                    for r, q, c in zip(i[hit], p[hit] + start, ALPHABET[a[hit]].astype(int))]
        if layout.touches(length - 1, lo, hi):
            before = np.bitwise_xor.accumulate(own, axis=1) ^ own
            after = np.zeros_like(own)
            after[:, :-1] = np.bitwise_xor.accumulate(mixed(at[:, :-1], m[:, 1:])[:, ::-1], axis=1)[:, ::-1]
            # Of a run of equal code points only the last is deleted: the others give the same edit.
            last = np.ones(m.shape, bool)
            last[:, :-1] = m[:, 1:] != m[:, :-1]
            i, p = np.nonzero(last)
            hit = known(before[i, p] ^ after[i, p], layout.kind(length - 1))
            yield ids[i[hit]], [words[rows[r]][:q] + words[rows[r]][q + 1:] for r, q in zip(i[hit], p[hit])]


def near_words(vocabulary: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Pairs of words one edit apart, both ways: word, n, near, near_n. ``vocabulary`` (word, n) is settled."""
    s, sc = settings, vocabulary.sparkSession.sparkContext
    kinds = vocabulary.groupBy(F.least(F.char_length("word"), F.lit(s.long_words)).alias("k")).count().collect()
    layout = Layout.of({r["k"]: r["count"] for r in kinds}, s)
    stretch = max(1, s.pass_bytes // 8)
    found = None
    # Words of one length in a task give it even work: deal them out by themselves.
    spread = vocabulary.repartition(shuffle_width(vocabulary), "word")
    for lo in range(0, layout.total, stretch):
        hi = min(layout.total, lo + stretch)
        filters = sc.broadcast(build(vocabulary, layout, lo, hi))

        def run(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi, filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for rows, edits in probe(words, layout, filters.value, lo, hi, s.probes):
                    if len(edits):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[r] for r in rows], pa.string()), pa.array(counts[rows]), pa.array(edits, pa.string())],
                            names=["from", "from_n", "word"])

        lengths = [k for k in range(1, s.long_words + 2) if layout.touches(k, lo, hi) or layout.touches(k - 1, lo, hi)]
        mine = spread.where(F.least(F.char_length("word"), F.lit(s.long_words + 1)).isin(lengths))
        known = mine.mapInArrow(run, "from string, from_n long, word string")
        pairs = settle(known.join(vocabulary, "word").select("from", "from_n", F.col("word").alias("to"), F.col("n").alias("to_n")), "near")
        filters.destroy()
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return vocabulary.selectExpr("word", "n", "word AS near", "n AS near_n").where(F.lit(False))
    return found.selectExpr("from AS word", "from_n AS n", "to AS near", "to_n AS near_n").unionAll(
        found.selectExpr("to AS word", "to_n AS n", "from AS near", "from_n AS near_n"))


def variant_words(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Every word with its form, root and counts: word, n, n_near, form, form_n, root.

    ``form`` is the near word with the most occurrences (the smallest of equals), if they are at least
    ``lead`` times the word's own; ``root`` is where the forms end. Counts at least double on the way, so
    it is short and ends; a way of m steps takes log2(m) joins. Null and empty texts have no words, an empty
    table gives no rows, words of any length are probed whole, and other columns of ``docs`` are not read.
    """
    vocabulary = settle(count_words(docs, settings), "vocabulary")
    near = near_words(vocabulary, settings).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    found = vocabulary.join(near, "word", "left")
    leads = -F.col("top.less") >= settings.lead * F.col("n")
    found = settle(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("top.near")).alias("form"), F.when(leads, -F.col("top.less")).alias("form_n")), "forms")
    ways = found.where("form IS NOT NULL").select("word", F.col("form").alias("up"))
    while True:
        on = ways.select(F.col("word").alias("up"), F.col("up").alias("top"))
        ways = settle(ways.join(on, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("went")), "roots")
        if ways.where("went").isEmpty():
            break
        ways = ways.drop("went")
    return found.join(ways.select("word", "up"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root"))


def variants_digest(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return variant_words(docs, settings).select("word", "form", "root", "n", "n_near", "form_n")
