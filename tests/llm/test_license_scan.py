import random
import re

import pytest

from lorekeep.llm.license_scan import BASE, Notice, Scanner, license_digest, pieces, scan_licenses

from .data import documents, frame


def brute(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for x in BASE:
        own = x.words.split()
        found += [(i, x.label) for i in range(len(words)) if words[i:i + len(own)] == own]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_digest_is_the_word_for_word_search(spark):
    extra = [(900, "cc by cc by\tcc-by CC.BY ccby", "en", "a", 0), (901, "all rights reserved all rights reserved", "en", "a", 0)]
    rows = documents() + extra
    got = {r.doc_id: r for r in license_digest(frame(spark, rows)).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_edits_and_spans():
    s = Scanner(BASE, (Notice("released under the mit license", "mit", 2),))
    got = s.scan("It is releasd under teh MIT License, yes")
    assert got["labels"] == ""  # two transposed letters are two edits, so three in all
    got = s.scan("It is releasd under the MIT Licence, yes")
    assert got["labels"] == "mit" and got["spans"][0]["first_word"] == 2 and got["spans"][0]["last_word"] == 6
    assert got["spans"][0]["edits"] == 2 and 0.9 < got["score"] < 1
    assert s.scan("released under the bsd license")["labels"] == ""


def test_pieces_cover_the_phrase():
    for edits in range(5):
        own = pieces("some longer phrase", edits)
        assert len(own) == edits + 1 and "".join(p for _, p in own) == "some longer phrase"


def test_other_columns_pass_through(spark):
    df = frame(spark).withColumnRenamed("lang", "license")
    assert scan_licenses(df).columns == ["doc_id", "text", "source", "n_chars", "license"]
    assert scan_licenses(frame(spark, [])).count() == 0


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_spans(text, notice):
    """All runs of whole words within the edits; of those that overlap the one with fewer edits, then the earlier."""
    words = text.split()
    own = []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            shown = " ".join(words[i:j])
            if abs(len(shown) - len(notice.words)) <= notice.edits:
                n = edits_between(notice.words, shown)
                if n <= notice.edits:
                    own.append((n, i, j))
    taken = []
    for n, i, j in sorted(own):
        if all(j <= a or i >= b for _, a, b in taken):
            taken.append((n, i, j))
    return sorted((i, j - 1, n) for n, i, j in taken)


def test_adjacent_notices_are_all_reported():
    s = Scanner(BASE, (Notice("all rights reserved", "reserved", 2),))
    got = s.scan("al rights reservd all rights reserved al rights reservd")["spans"]
    assert [(x["first_word"], x["edits"]) for x in got] == [(0, 2), (3, 0), (6, 2)]


@pytest.mark.parametrize("seed", range(40))
def test_spans_against_all_runs_of_words(seed):
    draw = random.Random(seed)
    notice = draw.choice((Notice("all rights reserved", "a", 2), Notice("released under the mit license", "b", 2),
                          Notice("licensed under the apache license", "c", 3)))
    parts = []
    for _ in range(draw.randrange(2, 9)):
        letters = list(notice.words)
        for _ in range(draw.randrange(notice.edits + 3)):
            at = draw.randrange(len(letters))
            what = draw.randrange(3)
            letters[at:at + (what != 0)] = draw.choice("qxz") if what != 1 else ""
        parts.append("".join(letters))
        parts += draw.choices(("lorem", "reserved", "mit", "under the", "ipsum dolor"), k=draw.randrange(3))
    text = " ".join(" ".join(parts).split())
    got = [(x["first_word"], x["last_word"], x["edits"]) for x in Scanner(BASE, (notice,)).scan(text)["spans"]]
    assert sorted(got) == plain_spans(text, notice)


def test_a_word_without_end():
    s = Scanner(BASE, (Notice("all rights reserved", "reserved", 2),))
    assert s.scan("reserved" * 50_000)["spans"] == []
