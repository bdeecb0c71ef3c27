import hashlib
import re
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm.imatch import SETTINGS, edited_digest, fingerprint

from .data import documents, frame

#: All terms of the little collection that more than one document has.
SMALL = replace(SETTINGS, low=0.0, high=1.0, rates=(1, 3, 5))


def test_edited_texts_against_brute_force(spark):
    rows = sorted(documents())
    got = {r.doc_id: r for r in edited_digest(frame(spark), SMALL).collect()}
    assert len(got) == len(rows)
    for k, (doc, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


def test_equal_texts_equal_fingerprints_and_order_does_not_count(spark):
    rows = documents()
    got = {r.doc_id: (r.text, r.fingerprint) for r in fingerprint(frame(spark), SMALL).collect()}
    by_text = {}
    for text, mark in got.values():
        assert by_text.setdefault(text or "", mark) == mark
    turned = [(d, " ".join(reversed(t.split())) if t else t, *rest) for d, t, *rest in rows]
    again = {r.doc_id: r.fingerprint for r in fingerprint(frame(spark, turned), SMALL).collect()}
    assert again == {d: m for d, (_, m) in got.items()}


def test_ties_nulls_and_single_rows(spark):
    rows = [(None, "a b", "", "", 0), (3, "a c", "", "", 0), (3, "a d", "", "", 0), (3, "a c", "", "", 0), (9, None, "", "", 0)]
    assert edited_digest(frame(spark, rows), SMALL).count() == 5
    one = edited_digest(frame(spark, rows[:1]), SMALL).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert edited_digest(frame(spark, []), SMALL).count() == 0


def plain_sets(texts, s):
    """Each text's terms in each subset, by plain sets; and all its terms."""
    def of(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return {xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)}

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    count = {}
    for text in texts:
        for term in of(text):
            count[term] = count.get(term, 0) + 1
    band = {t for t, n in count.items() if max(s.least, s.low * len(texts)) <= n <= max(s.least, s.high * len(texts))}
    seeds = np.random.default_rng(4).integers(0, 1 << 63, s.per_rate * len(s.rates), np.uint64)

    def subsets(text):
        own = of(text)
        return own, [{t for t in own & band if mixed(t ^ int(seed)) >> 64 - s.rates[k // s.per_rate] == 0} for k, seed in enumerate(seeds)]

    return subsets


def plain_likeness(a, b, s):
    (own, x), (other, y) = a, b
    if not any(x) or not any(y):
        return float(own == other) if not any(x) and not any(y) else 0.0
    best = 0.0
    for r in range(len(s.rates)):
        at = [k for k in range(r * s.per_rate, (r + 1) * s.per_rate) if x[k] or y[k]]
        same = sum(x[k] == y[k] for k in at)
        if at:
            best = max(best, same / (len(at) + 2 * (same < len(at))))
    return best


@pytest.mark.parametrize("broadcast_terms", [2_000_000, 0])
@pytest.mark.parametrize("band", [(0.0, 1.0), (0.02, 0.2)])
def test_likenesses_against_plain_sets_on_both_paths(spark, broadcast_terms, band):
    s = replace(SMALL, broadcast_terms=broadcast_terms, low=band[0], high=band[1])
    rows = sorted(documents())
    texts = [text or "" for _, text, *_ in rows]
    subsets = plain_sets(texts, s)
    got = {r.doc_id: r for r in edited_digest(frame(spark), s).collect()}
    assert len(got) == len(rows)
    marks = {}
    for k, (doc, *_) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        own, edited = subsets(text), subsets(text[:len(text) - half] + after[:half])
        r = got[doc]
        assert r.near_edited == pytest.approx(plain_likeness(own, edited, s))
        assert r.near_next == pytest.approx(plain_likeness(own, subsets(after), s))
        shown = r.fingerprint.split(",")
        assert shown[0].startswith("=") if not any(own[1]) else [x != "" for x in shown] == [bool(m) for m in own[1]]
        for mark, members in zip(shown, own[1]):
            if members:
                assert marks.setdefault(mark, members) == members
    again = {r.doc_id: r.fingerprint for r in fingerprint(frame(spark), s).collect()}
    assert again == {doc: r.fingerprint for doc, r in got.items()}


@pytest.mark.parametrize("broadcast_terms", [2_000_000, 0])
def test_edge_rows_on_both_paths(spark, broadcast_terms):
    s = replace(SMALL, broadcast_terms=broadcast_terms)
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, "", "", 0), (1, long, "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (None, "x y", "", "", 0)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("key", "row", "own", "inside", "term", "terms", "fingerprint", "_part", "_guest")})
    got = fingerprint(df, s)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 5
    assert len({r.fingerprint for r in got.collect()}) == 3
    assert edited_digest(df, s).count() == 5
    assert fingerprint(df.limit(0), s).count() == 0 and edited_digest(df.limit(0), s).count() == 0
