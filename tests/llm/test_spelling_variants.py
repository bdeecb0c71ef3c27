import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import pytest

from lorekeep.llm.spelling_variants import SETTINGS, count_words, near_words, variants_digest
from tests.llm.data import DOC_SCHEMA, frame


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    n = counted(rows)
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    mates = {w: [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if near(w, v)] for w in n}
    form = {}
    for w, vs in mates.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(mates[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(rng, w):
    at = rng.randrange(len(w))
    c = rng.choice("abcdefghijklmnopqrstuvwxyzàéß÷ÿÉ")
    return rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w + c])


def texts():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    words = base * 3 + [misspelt(rng, w) for w in base for _ in range(6)]
    words += [misspelt(rng, misspelt(rng, w)) for w in base for _ in range(3)]
    rows = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words) for _ in range(300)))
            for i in range(60)]
    long = "x" * 9000
    rows += [(1000, f"{long} {long} {long} {long}y {long}y {long}y a{long[2:]} a{long[2:]} a{long[2:]}"),
             (1001, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaa aaaa aaaa"), (1002, None), (1003, ""), (None, "abcde, ABCDE; ÀBCDE àbcde")]
    # A way of many steps: each word twice as frequent as the one before it.
    for k in range(7):
        rows += [(2000 + k, " ".join(["qqqqqqqq"[:8 - k] + "zzzzzzz"[:k]] * (3 << k)))]
    return rows + rows[:5]


def both(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def want():
    return brute(texts())


def test_matches_brute_force(spark, want):
    got = sorted(tuple(r) for r in variants_digest(both(spark, texts())).collect())
    assert got == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] != w[0] for w in want)


@pytest.mark.parametrize("bits", [1, 20])
def test_small_filters_and_many_passes(spark, want, bits):
    """Full filters let false positives through and short stretches take many passes; rows stay the same."""
    settings = replace(SETTINGS, pass_bytes=96 if bits == 1 else 400, bits_a_word=bits, probes=2000, words=50)
    got = sorted(tuple(r) for r in variants_digest(both(spark, texts()), settings).collect())
    assert got == want


def test_filters_keep_most_edits_away(spark):
    from lorekeep.llm import spelling_variants as sv

    vocabulary = sorted(counted(texts()))
    layout = sv.Layout.of(dict(Counter(min(len(w), 64) for w in vocabulary)), SETTINGS)
    df = spark.createDataFrame([(w, 1) for w in vocabulary], "word string, n long")
    blocks = sv.build(df, layout, 0, layout.total)
    there = set(vocabulary)
    found = [(vocabulary[r], e) for rows, edits in sv.probe(vocabulary, layout, blocks, 0, layout.total, 1 << 20)
             for r, e in zip(rows, edits)]
    hits = [f for f in found if f[1] in there]
    pairs = {(a, b) for a in vocabulary for b in vocabulary if a < b and near(a, b)}
    assert sorted(tuple(sorted(h)) for h in hits) == sorted(pairs)
    # Some 300,000 edits are probed.
    assert len(found) - len(hits) < 3000


def test_nothing_to_group(spark):
    assert variants_digest(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert variants_digest(both(spark, [(1, "one two"), (2, None), (3, "")])).count() == 0
    alone = variants_digest(both(spark, [(1, "apple apple apple")])).collect()
    assert [tuple(r) for r in alone] == [("apple", None, "apple", 3, 0, None)]


def test_extra_columns_are_not_read(spark):
    df = frame(spark).selectExpr("*", "1 AS word", "2 AS n", "'x' AS near", "3 AS up", "4 AS form")
    want = brute([(r[0], r[1]) for r in frame(spark).collect()])
    assert sorted(tuple(r) for r in variants_digest(df).collect()) == want
    assert {r.word: r.n for r in count_words(df).collect()} == {w[0]: w[3] for w in want}


def test_pairs_come_once_each_way(spark):
    df = both(spark, texts())
    pairs = [(r.word, r.near) for r in near_words(count_words(df)).collect()]
    assert len(pairs) == len(set(pairs)) and {(b, a) for a, b in pairs} == set(pairs)
