"""I-Match fingerprints over randomised lexicon subsets.

Terms of middling document frequency make the lexicon. Each subset of it, drawn at
random, gives one hash per document: that of the document's sorted distinct terms in
the subset. Sparse subsets often miss what was edited, so the share of equal hashes
says how alike two documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import shuffle_width, slices

CACHE_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    """The band of document frequencies, as shares of all documents, and the subsets.

    A term in the lexicon lies in at least ``low`` of all documents, so the lexicon holds at
    most (distinct terms of an average document) / ``low`` terms, however many documents there are.
    """

    low: float = 0.001
    high: float = 0.1
    #: A term must be in this many documents at least.
    least: int = 2
    #: Subsets keep 1 / 2 ** r of the lexicon, for each r this many.
    rates: tuple[int, ...] = (4, 6, 8, 10)
    per_rate: int = 24
    #: Lexicons up to this size are broadcast; larger ones join the documents' terms.
    broadcast_terms: int = 2_000_000


SETTINGS = Settings()


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _word_table() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalnum() else 32
    return bytes(table)


TABLE = _word_table()


def terms(text: str, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the words (lower-cased A-Z; split at other ASCII than letters and digits)."""
    words = set(text.encode("utf-8", "surrogatepass").translate(TABLE).split())
    return np.sort(np.fromiter((known[w] for w in words), np.uint64, len(words)))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): counted in each task first, in tables of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHash(), [], 0

        def flush() -> pa.RecordBatch:
            term, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))], names=["term", "n"])

        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                held.append(terms(t or "", known))
                size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon_of(docs: DataFrame, s: Settings) -> DataFrame:
    """Terms inside the band of inverse document frequencies."""
    total = docs.count()
    return settle(document_frequencies(docs).where(
        F.col("df").between(max(s.least, s.low * total), max(s.least, s.high * total))).select("term"), "lexicon")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Fingerprints from the terms that a sorted lexicon holds; the lexicon is empty where a join picks them."""

    def __init__(self, lexicon: np.ndarray, s: Settings):
        self.lexicon, self.known, self.s = lexicon, WordHash(), s
        count = s.per_rate * len(s.rates)
        self.seeds = np.random.default_rng(4).integers(0, 1 << 63, count, np.uint64)
        self.shift = np.repeat(np.array([64 - r for r in s.rates], np.uint64), s.per_rate)

    def of(self, text: str) -> list[str]:
        own = terms(text, self.known)
        at = np.searchsorted(self.lexicon, own)
        inside = own[(at < len(self.lexicon)) & (self.lexicon[np.minimum(at, len(self.lexicon) - 1)] == own)] if len(self.lexicon) else own[:0]
        return self.of_terms(own, inside)

    def of_terms(self, own: np.ndarray, inside: np.ndarray) -> list[str]:
        """A hash for each subset, empty where the document has no term of it; without any term of the
        lexicon one hash of all its terms. Both arrays are sorted."""
        out = [""] * len(self.seeds)
        subset, term = np.nonzero((mix(inside[:, None] ^ self.seeds) >> self.shift == 0).T)
        cuts = np.flatnonzero(np.diff(subset)) + 1
        for k, members in zip(subset[np.append(0, cuts)] if len(subset) else (), np.split(inside[term], cuts)):
            out[k] = f"{xxhash.xxh3_64_intdigest(members.tobytes()) >> 32:08x}"
        return out if any(out) else [f"={xxhash.xxh3_64_hexdigest(own.tobytes())}"]


def likeness(a: list[str], b: list[str], s: Settings) -> float:
    """Of the subsets in which one of two documents has terms, the share that agree; the rate that shows most counts."""
    if len(a) != len(b) or len(a) == 1:
        return float(a == b)
    best = 0.0
    for r in range(len(s.rates)):
        pairs = [(x, y) for x, y in zip(a[r * s.per_rate:(r + 1) * s.per_rate], b[r * s.per_rate:(r + 1) * s.per_rate]) if x or y]
        if pairs:
            # Few subsets say little: two that disagree are added.
            best = max(best, sum(x == y for x, y in pairs) / (len(pairs) + 2 * any(x != y for x, y in pairs)))
    return best


def fingerprint(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``docs`` with ``fingerprint``, the comma-joined hashes of the subsets, for each whole text.

    Null texts are empty; equal texts have equal fingerprints; an empty table gives one. Other
    columns pass through, whatever their names; one named ``fingerprint`` is replaced.
    """
    lexicon = lexicon_of(docs, s)
    held = broadcast_lexicon(lexicon, s)
    kept = docs.drop("fingerprint")
    if held is None:
        rows = kept.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("key"))
        marks = joined_fingerprints(keyed_terms(kept), lexicon, s)
        return rows.join(marks, "key").select("row.*", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(held.value, s)
        for batch in slices(batches, "text"):
            yield batch.append_column("fingerprint", pa.array([",".join(maker.of(t or "")) for t in batch.column("text").to_pylist()]))

    return kept.mapInArrow(run, kept.withColumn("fingerprint", F.lit("")).schema)


def broadcast_lexicon(lexicon: DataFrame, s: Settings) -> Broadcast | None:
    """The lexicon as a sorted array on every executor; None if it holds more than ``broadcast_terms``."""
    if lexicon.count() > s.broadcast_terms:
        return None
    return lexicon.sparkSession.sparkContext.broadcast(np.sort(lexicon.toPandas()["term"].to_numpy(np.int64).view(np.uint64)))


def key_of(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def text_key(text: Column) -> Column:
    """What ``key_of`` gives, in the JVM."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


KEYED = "key binary, terms array<long>"


def _keyed(rows: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([t.view(np.int64) for _, t in rows], pa.list_(pa.int64()))],
        names=["key", "terms"])


def keyed_terms(docs: DataFrame) -> DataFrame:
    """(key, terms) of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in slices(batches, "text"):
            yield _keyed([(key_of(t or ""), terms(t or "", known)) for t in batch.column("text").to_pylist()])

    return docs.select("text").mapInArrow(run, KEYED)


def joined_fingerprints(keyed: DataFrame, lexicon: DataFrame, s: Settings) -> DataFrame:
    """(key, fingerprint) of the distinct keys, for a lexicon of any size: each text's terms meet it in a join."""
    pairs = keyed.dropDuplicates(["key"]).select("key", F.explode_outer("terms").alias("term"))
    met = pairs.join(lexicon.select("term", F.lit(True).alias("inside")), "term", "left")
    sets = met.groupBy("key").agg(
        F.collect_list("term").alias("own"), F.collect_list(F.when(F.col("inside"), F.col("term"))).alias("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(np.zeros(0, np.uint64), s)
        for batch in batches:
            own, inside = ([np.sort(np.array(x.as_py(), np.int64).view(np.uint64)) for x in batch.column(c)] for c in ("own", "inside"))
            marks = [",".join(maker.of_terms(a, b)) for a, b in zip(own, inside)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(marks, pa.string())], names=["key", "fingerprint"])

    return sets.mapInArrow(run, "key binary, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of (doc_id, text) in parts that follow each other in doc_id; each part ends with the next one's first row.

    Adds ``_part``, ``_guest`` (that first row) and ``_tie``. The bounds are approximate quantiles of
    the ids, as many as parts; they and the first id of each part are all that the driver sees.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"))
    quantiles = [i / parts for i in range(1, parts)] or [0.5]
    bounds = np.unique(np.array(ids.agg(F.percentile_approx("_id", quantiles, 10_000).alias("q")).first()["q"] or [0], np.int64))

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), "right").astype(np.int32))

    firsts = {r["_part"]: r["f"] for r in ids.groupBy(part_of("_id").alias("_part")).agg(F.min("_id").alias("f")).collect()}
    own = sorted(firsts)
    first_ids = np.array([firsts[p] for p in own], np.int64)
    before = np.array([own[i - 1] for i in range(len(own))], np.int32)  # the last part precedes the first

    @F.pandas_udf("array<int>")
    def parts_of(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.int64)
        part = np.searchsorted(bounds, v, "right")
        at = np.minimum(np.searchsorted(first_ids, v), max(len(first_ids) - 1, 0))
        guest = first_ids[at] == v
        return pd.Series([[int(p), int(before[i])] if g else [int(p)] for p, i, g in zip(part, at, guest)])

    rows = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = rows.select("*", F.posexplode(parts_of("_id")).alias("_guest", "_part"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    return rows.repartition(parts, "_part").sortWithinPartitions("_part", "_guest", "_id", "_tie").drop("_id")


def with_next(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make()``, called in each task, gets of every document id, text and the next one's text, and gives a row.

    ``rows`` come from ``in_order``. A part is streamed through, so a task holds two documents
    and a few megabytes.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*((n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        waiting = part = None
        for batch in slices(batches, "text"):
            out = []
            for doc, text, guest, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_guest", "_part"))):
                if at != part:
                    waiting, part = None, at
                if guest and waiting is None:
                    continue  # a second guest with the same id
                text = text or ""
                if waiting is not None:
                    out.append(row(*waiting, text))
                waiting = None if guest else (doc, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, schema)


def edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


DIGEST = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_digest(docs: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text's last half is replaced by the beginning of the next document in
    doc_id order (after the last: the first; equal ids in the order of a hash of their
    texts; null ids first). Rows travel once, into parts of neighbouring ids. Null texts are
    empty, repeated rows count each, an empty table gives none, other columns are not read.
    """
    lexicon = lexicon_of(docs, s)
    held = broadcast_lexicon(lexicon, s)
    rows = in_order(docs.select("doc_id", "text"), 2 * shuffle_width(docs))
    if held is None:
        return _joined_digest(rows, lexicon, s)

    def make():
        maker, last = Fingerprinter(held.value, s), [None, None]

        def of(text: str) -> list[str]:
            if last[0] != text:
                last[:] = text, maker.of(text)
            return last[1]

        def row(doc: int, text: str, after: str) -> tuple:
            own, edited = of(text), edit(text, after)
            changed = maker.of(edited)
            return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    ",".join(own), ",".join(changed), likeness(own, changed, s), likeness(own, of(after), s))

        return row

    return with_next(rows, DIGEST, make)


def _joined_digest(rows: DataFrame, lexicon: DataFrame, s: Settings) -> DataFrame:
    """The digest where the lexicon is joined: terms of own and edited texts first, then three looks at their fingerprints."""
    def make():
        known = WordHash()

        def row(doc: int, text: str, after: str) -> tuple:
            edited = edit(text, after)
            return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), key_of(text), key_of(edited),
                    key_of(after), terms(text, known).view(np.int64), terms(edited, known).view(np.int64))

        return row

    wide = settle(with_next(rows, "doc_id long, n_chars long, edited_sha256 string, key binary, edited_key binary, next_key binary, "
                                  "terms array<long>, edited_terms array<long>", make), "imatch_terms")
    keyed = wide.select("key", "terms").union(wide.select("edited_key", "edited_terms"))
    marks = settle(joined_fingerprints(keyed, lexicon, s), "imatch_marks")
    found = wide.drop("terms", "edited_terms")
    for key, mark in (("key", "fingerprint"), ("edited_key", "edited_fingerprint"), ("next_key", "next_fingerprint")):
        found = found.join(marks.select(F.col("key").alias(key), F.col("fingerprint").alias(mark)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, edited, after = ([x.as_py().split(",") for x in batch.column(c)]
                                  for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
            near = [[likeness(a, b, s) for a, b in zip(own, other)] for other in (edited, after)]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, *(pa.array(x, pa.float64()) for x in near)], names=[*names, "near_edited", "near_next"])

    names = [x.split()[0] for x in DIGEST.split(", ")][:5]
    return found.mapInArrow(run, DIGEST)
