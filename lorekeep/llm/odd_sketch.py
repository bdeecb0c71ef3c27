"""Near-duplicate documents by MinHash bands, odd sketches and exact set comparison.

A document is its set of distinct five-word shingles. MinHash samples give banded
candidate buckets; the same samples are folded into a parity bitmap, an odd sketch,
in which the bits that differ between two documents estimate their similarity. Pairs
whose estimate leaves a chance are compared on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import components, shuffle_width, slices

CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    """Shingle length, similarity, and the size of samples and sketches.

    A pair at the similarity is missed by all bands with probability
    ``(1 - similarity ** rows) ** bands``: 2.5e-7 here. The estimate from all samples has a standard
    error of 0.020 for such a pair, the parity bits add 0.010, so ``estimate`` lies five errors below.
    """

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    #: Samples that only the sketch holds, beside those of the bands.
    more: int = 320
    sketch_bits: int = 2048
    estimate: float = 0.64
    #: Documents that are compared with one hub in one run.
    chunk: int = 64
    #: Documents that a block holds, and that stream past them.
    block: int = 256
    stream: int = 1024


SETTINGS = Settings()


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, known: WordHash, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; all words as one if there are fewer."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in own), np.uint64, len(own))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sample_parameters(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    size = s.bands * s.rows + s.more
    return rng.integers(0, 1 << 31, size, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size, np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty ``sets``."""
    a, b = sample_parameters(s)
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    least = np.empty((len(sets), len(a)), np.uint64)
    for j in range(len(a)):
        least[:, j] = np.minimum.reduceat(joined * a[j] + b[j], starts)
    keys, banded = np.zeros((len(sets), s.bands), np.uint64), s.bands * s.rows
    for r in range(s.rows):
        keys = mix(keys ^ least[:, r:banded:s.rows])
    keys = mix(keys + np.arange(s.bands, dtype=np.uint64))
    # Each sample flips one bit: equal samples flip the same one, so they cancel in an XOR.
    bit = (mix(least + np.arange(len(a), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(s.sketch_bits))
    sketch = np.zeros((len(sets), s.sketch_bits // 64), np.uint64)
    for j in range(len(a)):
        sketch[np.arange(len(sets)), bit[:, j] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, j] & np.uint64(63))
    return keys.view(np.int64), sketch.view(np.int64)


def most_differing_bits(s: Settings) -> int:
    """Bits that may differ for the estimate ``s.estimate``, by the expected parity of that many flips."""
    flips = 2 * (s.bands * s.rows + s.more) * (1 - s.estimate)
    return math.ceil(s.sketch_bits / 2 * (1 - (1 - 2 / s.sketch_bits) ** flips))


def sign_documents(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch); the last three are null for an empty set."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                      ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingles(t.as_py(), known, s.words) for t in batch.column("text")]
            full = [x for x in sets if len(x)]
            bands, sketches = signatures(full, s) if full else ((), ())
            rows = iter(zip(bands, sketches))
            cols = [[xxhash.xxh3_128_digest(x.tobytes()), *next(rows)] if len(x) else [None] * 3 for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                 *(pa.array(c, t) for c, t in zip(zip(*cols), kind.types[2:]))], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def differing_bits(a: str, b: str, s: Settings):
    """Bits in which two sketch columns differ."""
    words = range(s.sketch_bits // 64)
    return sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in words), F.lit(0))


def likely(pairs: DataFrame, s: Settings):
    """Whether sizes and sketches leave a chance; columns _na, _sa, _nb, _sb."""
    fits = 100 * F.least("_na", "_nb") >= s.percent * F.greatest("_na", "_nb")
    return fits & (differing_bits("_sa", "_sb", s) <= most_differing_bits(s))


def signs(reps: DataFrame, name: str, end: str) -> DataFrame:
    return reps.select(F.col("rep").alias(name), F.col("n").alias(f"_n{end}"), F.col("sketch").alias(f"_s{end}"))


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough.

    The b of one a come in chunks of bounded size, each led by the text of a; a task
    streams through its chunks and holds the set of one a at a time.
    """
    texts = docs.select(F.col("doc_id").alias("b"), "text")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / s.chunk).cast("int").alias("_n"))
    dealt = pairs.join(chunks, "a").withColumn("_chunk", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int"))
    leads = chunks.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_chunk"))
    rows = dealt.select("a", "b", "_chunk").unionByName(leads).hint("merge").join(texts, "b")
    rows = rows.repartition(shuffle_width(docs), "a", "_chunk").withColumn("_lead", F.col("a") != F.col("b"))
    rows = rows.sortWithinPartitions("a", "_chunk", "_lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, own = WordHash(), None, None
        for batch in slices(batches, "text"):
            found = []
            for a, b, chunk, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "_chunk", "text"))):
                new = shingles(text, known, s.words)
                if a == b:
                    at, own = (a, chunk), new
                elif at == (a, chunk):
                    both = len(np.intersect1d(own, new, assume_unique=True))
                    if 100 * both >= s.percent * (len(own) + len(new) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def across_components(met: DataFrame, placed: DataFrame, reps: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between documents that met under one hub but lie in different components.

    ``met`` has (hub, rep), ``placed`` (rep, component). Outside a hub's largest component lie
    those that are held against all of its members. They are cut into blocks, the members into
    streams; a task holds the sets of one block while a stream goes by, so what is
    shuffled is documents, each once per block or stream, never pairs.
    """
    rows = met.join(placed, "rep")
    parts = rows.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("_n"))
    mains = parts.groupBy("hub").agg(
        F.max_by("component", F.struct("_n", -F.col("component"))).alias("_main"), F.count(F.lit(1)).alias("_parts"),
        F.sum("_n").alias("_all"), F.max("_n").alias("_most")).where("_parts > 1")
    mains = mains.select("hub", "_main", F.ceil((F.col("_all") - F.col("_most")) / s.block).cast("int").alias("_nx"),
                         F.ceil(F.col("_all") / s.stream).cast("int").alias("_ny"))
    rows = rows.join(mains, "hub").withColumn("_outer", F.col("component") != F.col("_main"))
    place = F.xxhash64("rep")
    x = rows.where("_outer").select(
        "hub", "rep", "component", "_outer", F.lit(0).alias("_side"), F.pmod(place, F.col("_nx")).cast("int").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)).alias("_j"))
    y = rows.select(
        "hub", "rep", "component", "_outer", F.lit(1).alias("_side"),
        F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)).alias("_i"), F.pmod(place, F.col("_ny")).cast("int").alias("_j"))
    rows = x.unionByName(y).join(reps.select("rep", "sketch"), "rep").hint("merge").join(
        docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    rows = rows.repartition(shuffle_width(docs), "hub", "_i", "_j").sortWithinPartitions("hub", "_i", "_j", "_side")
    limit = most_differing_bits(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, held, sketches, own_of = WordHash(), None, [], None, None
        for batch in slices(batches, "text"):
            found = []
            cols = (batch.column(c).to_pylist() for c in (
                "hub", "_i", "_j", "_side", "rep", "component", "_outer", "sketch", "text"))
            for hub, i, j, side, doc, component, outer, sketch, text in zip(*cols):
                if at != (hub, i, j):
                    at, held, sketches = (hub, i, j), [], None
                bits = np.array(sketch, np.int64).view(np.uint64)
                own = shingles(text, words, s.words)
                if not side:
                    held.append((doc, component, own, bits))
                    continue
                if sketches is None:
                    sketches = np.array([x[3] for x in held]).reshape(-1, len(bits))
                    ids, own_of = np.array([x[0] for x in held]), np.array([x[1] for x in held])
                    sizes = np.array([len(x[2]) for x in held])
                # Of two that are both outside, the one with the smaller id asks.
                fits = (own_of != component) & ((ids < doc) | (not outer))
                fits &= 100 * np.minimum(sizes, len(own)) >= s.percent * np.maximum(sizes, len(own))
                near = np.flatnonzero(fits)
                for k in near[np.bitwise_count(sketches[near] ^ bits).sum(1) <= limit]:
                    other = held[k][2]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= s.percent * (len(own) + len(other) - both):
                        found.append((held[k][0], doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def link_documents(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents with equal sets are one class, led by its smallest doc_id; classes meet in
    the buckets of their bands. First every class is compared with the hub of each of its
    buckets, the class that meets most others: of a document and its edited copies that
    is the document. Where a hub's buckets then still hold several components, the classes
    outside the largest are held against all others there, in blocks, if size and odd
    sketch leave a chance. So no pair inside a component is looked at
    again, and no bucket is written out as pairs. A null or empty text has an empty set and links with nothing; doc_ids
    are taken as distinct (equal rows give equal results); a null doc_id links with
    nothing. Other columns are not looked at; an empty table gives no rows.
    """
    signed = settle(sign_documents(docs, s), "signed")
    first = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min_by(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands", "sketch"), "doc_id").alias("_r"))
    reps = settle(first.select("set_key", F.col("_r.doc_id").alias("rep"), "_r.n", "_r.bands", "_r.sketch"), "classes")
    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("_met")).where("_met > 1")
    shared = settle(members.join(buckets, "key"), "buckets")
    degrees = shared.groupBy("rep").agg(F.sum("_met").alias("_degree"))
    hubs = shared.join(degrees, "rep").groupBy("key").agg(F.max_by("rep", F.struct("_degree", -F.col("rep"))).alias("a"))

    met = settle(shared.join(hubs, "key").select(F.col("a").alias("hub"), "rep").distinct(), "met")
    stars = met.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    stars = stars.join(signs(reps, "b", "b"), "b").join(signs(reps, "a", "a"), "a")
    stars = settle(stars.where(likely(stars, s)).select("a", "b"), "stars")
    links = settle(verified(stars, docs, s), "links")
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    placed = settle(reps.select("rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component")), "placed")
    more = settle(across_components(met, placed, reps, docs, s), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    label = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
