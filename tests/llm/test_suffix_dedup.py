import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from lorekeep.llm.suffix_dedup import SETTINGS, filter_of, least_places, passes, remove_repeats, repeats_digest, shared_windows

from .data import documents, frame

W = SETTINGS.window


def brute(rows):
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = Counter(b[k:k + W] for _, b in raw for k in range(len(b) - W + 1))
    out = []
    for d, b in raw:
        spans = []
        for k in range(len(b) - W + 1):
            if count[b[k:k + W]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + W
                else:
                    spans.append([k, k + W])
        left, at = b"", 0
        for lo, hi in spans:
            left, at = left + b[at:lo], hi
        left += b[at:]
        out.append((d, len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def passages():
    """One passage in many different surroundings, at lengths around the window."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common, rows = text(400), []
    for i in range(60):
        rows.append((3000 + i, text(rng.randrange(150)) + common[rng.randrange(120):400 - rng.randrange(120)] + text(rng.randrange(150)), "en", "a", 0))
    return rows


@pytest.mark.parametrize("settings", [SETTINGS, replace(SETTINGS, group=4), replace(SETTINGS, block=7, collection=900)])
def test_matches_brute_force(spark, settings):
    rows = documents() + passages()
    got = sorted((tuple(r) for r in repeats_digest(frame(spark, rows), settings).collect()), key=repr)
    assert got == brute(rows)


def test_copies_with_one_id_and_odd_rows(spark):
    rows = [(1, "q" + "ab cd" * 60, "", "", 0)] * 2 + [(None, "q" + "ab cd" * 60, "", "", 0), (None, None, "", "", 0), (2, "short", "", "", 0)]
    got = sorted((tuple(r) for r in repeats_digest(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    df = frame(spark, rows).selectExpr("*", "1 as repeats", "2 as text_key", "3 as lo")
    done = remove_repeats(df)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "lo", "repeats"] and done.count() == 5
    assert repeats_digest(frame(spark, [])).count() == 0


def test_shared_windows_of_one_collection():
    rng = np.random.default_rng(1)
    core = rng.bytes(260)
    bodies = [rng.bytes(k) + core + rng.bytes(30) for k in (8, 16, 3, 25)] + [rng.bytes(300)]
    leads = np.array([8 + 100, 16 + 100, 3 + 100, 25 + 100, 50])
    for block in (5, 1 << 18):
        got = shared_windows(bodies, leads, replace(SETTINGS, block=block))
        count = Counter(b[k:k + W] for b in bodies for k in range(len(b) - W + 1))
        for body, own in zip(bodies, got):
            assert own.tolist() == [k for k in range(len(body) - W + 1) if count[body[k:k + W]] > 1]
        assert len(got[0]) >= 61 and not len(got[-1])


@pytest.mark.parametrize("many, most", [(20_000, 28), (20_000, 12), (0, 28)])
def test_the_driver_gets_the_filter_in_parts(spark, monkeypatch, many, most):
    anchors = np.random.default_rng(9).integers(-(1 << 63), 1 << 63, many, np.int64)
    df, rows = spark.createDataFrame([(a, True) for a in anchors.tolist()], "anchor long, many boolean"), []
    for name in ("collect", "toPandas"):
        def counted(self, f=getattr(type(df), name)):
            got = f(self)
            rows.append(len(got))
            return got
        monkeypatch.setattr(type(df), name, counted)
    bitmap, bits = filter_of(df, most)
    assert sum(rows) <= 2 + (1 << bits >> 15)
    assert bits == min(most, max(16, many.bit_length() + 4))
    want = np.zeros(1 << bits, bool)
    want[(anchors & ((1 << bits) - 1))] = True
    assert np.array_equal(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool), want)
    assert passes(bitmap, bits, anchors.view(np.uint64)).all()


def test_a_repeat_beyond_16_mib_of_a_text(spark):
    rng = np.random.default_rng(3)
    words = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    long, common = words((1 << 24) + 5_000), words(600)
    rows = [(1, long + common + words(90), "", "", 0), (2, words(70) + common + words(40), "", "", 0)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats_digest(frame(spark, rows)).collect()}
    assert got == {1: (600, 1), 2: (600, 1)}


def test_places_do_not_depend_on_the_stretch():
    grams = np.random.default_rng(4).integers(0, 40, 500, np.uint64) << np.uint64(24)
    want = [k + int(np.argmin(grams[k:k + 9])) for k in range(492)]
    for stretch in (9, 10, 50, 499, 500, 1 << 22):
        assert least_places(grams, 9, stretch).tolist() == want


def test_helper_names_pass_through_and_cut_characters_go(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(250))
    # The first bytes of à and é are equal and go with the passage, so both letters go.
    rows = [(1, "aé�" + passage + "à�b", "en", "s", 0), (2, "x" + passage + "éyz", "en", "s", 0), (3, "�", "en", None, 0)]
    df = frame(spark, rows).selectExpr("*", "1 as _d", "2 as _k", "3 as _spans", "4 as row", "5 as again", "6 as own_doc", "7 as spans",
                                       "8 as `a.b`", "9 as Repeats")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert all(tuple(r)[5:13] == (1, 2, 3, 4, 5, 6, 7, 8) for r in got.values())
    assert got[1].repeats.text == "aé��b" and got[2].repeats.text == "xyz" and got[3].repeats.text is None
