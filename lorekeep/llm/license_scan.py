"""Fuzzy search for short license notices.

A notice may differ from its phrase by a few edits. Split a phrase into one piece
more than edits are allowed: by the pigeonhole principle one piece is untouched.
All pieces are sought at once with an Aho-Corasick automaton; around each hit the
``regex`` library's bounded-error matching decides and reports the span.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices


@dataclass(frozen=True)
class Notice:
    """Words of a notice (lower case, single spaces), its label and the edits allowed."""

    words: str
    label: str
    edits: int = 0


#: The phrases every result counts, word for word.
BASE = (
    Notice("cc by", "cc-by"),
    Notice("general public license", "gpl"),
    Notice("all rights reserved", "reserved"),
)

#: Notices found with up to ``edits`` inserted, deleted or replaced characters.
NOTICES = (
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("licensed under the apache license", "apache", 3),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("licensed under cc by sa", "cc-by-sa", 1),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("all rights reserved", "reserved", 2),
)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("edits", T.IntegerType()),
        T.StructField("matched", T.StringType()),
    ]))),
])


def _word_table() -> bytes:
    """Lower-case A-Z; every other ASCII byte that is no digit or letter becomes a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalnum() else 32
    return bytes(table)


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces of near equal length, each with its place."""
    n = edits + 1
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


BOUND = regex.compile(r"\b")


class SortedSpans:
    """Spans without overlaps, by their start."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def add(self, start: int, stop: int) -> bool:
        """Take the span in unless it overlaps one that is there."""
        at = bisect(self.spans, (start, stop))
        if (at and self.spans[at - 1][1] > start) or (at < len(self.spans) and self.spans[at][0] < stop):
            return False
        self.spans.insert(at, (start, stop))
        return True


class Scanner:
    """Scans one text at a time; built once per task."""

    def __init__(self, base: tuple[Notice, ...], notices: tuple[Notice, ...]):
        self.table = _word_table()
        self.base = [(f" {x.words} ".encode(), x.label) for x in base]
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for no, x in enumerate(notices):
            for at, piece in pieces(x.words, x.edits):
                held.setdefault(piece, []).append((no, at))
        for piece, places in held.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.fuzzy = [
            regex.compile(rf"(?be)\b(?:{regex.escape(x.words, literal_spaces=True)}){{e<={x.edits}}}\b") for x in notices
        ]

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(self.table).split()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """Start word and label of every place of a base phrase."""
        found = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            before, counted = 0, 0
            while at >= 0:
                before += joined.count(b" ", counted, at)
                counted = at
                found.append((before, label))
                at = joined.find(phrase, at + 1)
        return found

    def near(self, joined: str) -> list[tuple[str, int, int, int, str]]:
        """(label, first word, last word, edits, matched words) of fuzzy notices.

        Each seed's own window is searched, and what lies before and behind a match in it.
        Of places of one notice that overlap, the one with fewer edits counts, then the earlier.
        """
        windows: set[tuple[int, int, int]] = set()
        for end, (length, places) in self.seeds.iter(joined):
            for no, at in places:
                x = self.notices[no]
                begin = end + 1 - length - at
                windows.add((no, max(0, begin - x.edits - 1), min(len(joined), begin + len(x.words) + x.edits + 1)))
        places: dict[int, set[tuple[int, int, int]]] = {}
        for no, start, stop in windows:
            # The search takes its end for the end of a word, so the window ends where a word does.
            ends = [m.start() for m in BOUND.finditer(joined, start, stop + 1) if m.start() <= stop]
            places.setdefault(no, set()).update(self._matches(no, joined, start, ends[-1] if ends else start))
        found = []
        for no, own in places.items():
            taken = SortedSpans()
            for edits, start, stop in sorted(own):
                if taken.add(start, stop):
                    shown = joined[start:stop]
                    first = joined.count(" ", 0, start + (shown[:1] == " ")) - 1
                    shown = shown.strip()
                    found.append((self.notices[no].label, first, first + shown.count(" "), edits, shown))
        return found

    def _matches(self, no: int, joined: str, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        m = self.fuzzy[no].search(joined, start, stop) if stop > start else None
        if m and m.end() > m.start():
            yield sum(m.fuzzy_counts), m.start(), m.end()
            yield from self._matches(no, joined, start, m.start())
            yield from self._matches(no, joined, m.end(), stop)

    def scan(self, text: str | None) -> dict:
        words = self.words(text)
        joined = b" " + b" ".join(words) + b" "
        exact = self.exact(joined)
        near = self.near(joined.decode("utf-8", "surrogatepass"))
        lengths = {x.label: max(len(y.words) for y in self.notices if y.label == x.label) for x in self.notices}
        best = max((1 - edits / lengths[label] for label, _, _, edits, _ in near), default=0.0)
        starts = [at for at, _ in exact]
        base = sorted({label for _, label in exact})
        return {
            "n_words": len(words), "n_base": len(exact),
            "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(x[0] for x in near)})),
            "score": 1.0 if exact else max(0.0, best),
            "spans": [dict(zip(("label", "first_word", "last_word", "edits", "matched"), x)) for x in sorted(near)],
        }


def scan_licenses(
    docs: DataFrame, text: str = "text", base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES,
) -> DataFrame:
    """``docs`` with one struct ``license`` of what was found in each whole text.

    Narrow: nothing is shuffled, and a row needs memory for its own text only.
    A null or empty text has no words, no labels, score 0 and no spans; an empty table
    gives an empty one. Repeated rows are scanned each; other columns pass through, also one named ``license``,
    which is replaced.
    """
    kept = docs.drop("license")
    schema = T.StructType([*kept.schema.fields, T.StructField("license", RESULT)])
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                      ("edits", pa.int32()), ("matched", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in slices(batches, text):
            found = pa.array([scanner.scan(x.as_py()) for x in batch.column(text)], kind)
            yield batch.append_column("license", found)

    return kept.mapInArrow(run, schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per document without the spans."""
    return scan_licenses(docs.select("doc_id", "text")).select("doc_id", "license.*").drop("spans").withColumn(
        "score", F.round("score", 6))
