import random
import re
from dataclasses import replace

import numpy as np

from lorekeep.llm.odd_sketch import SETTINGS, WordHash, link_documents, most_differing_bits, shingles, signatures

from .data import documents, frame


def brute(rows):
    sets = {}
    for doc, text, *_ in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(own[k:k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())
        sets[doc] = grams
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def near_group(n=40):
    """Copies of which many are near only to some of the others."""
    rng = random.Random(9)
    base, rows = [f"v{rng.randrange(900)}" for _ in range(150)], []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(150)] = f"n{rng.randrange(9000)}"
        rows.append((5000 + i, " ".join(own), "en", "a", 0))
    return rows


def test_matches_brute_force(spark):
    rows = documents() + near_group()
    got = {r.doc_id: tuple(r)[1:] for r in link_documents(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_small_chunks_give_the_same(spark):
    rows = documents() + near_group()
    got = {r.doc_id: tuple(r)[1:] for r in link_documents(frame(spark, rows), replace(SETTINGS, chunk=2)).collect()}
    assert got == brute(rows)


def test_sketch_estimates_similarity():
    rng, known = random.Random(1), WordHash()
    limit = most_differing_bits(SETTINGS)
    for _ in range(20):
        base = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        near = base[:330] + [f"u{rng.randrange(10**6)}" for _ in range(70)]
        far = base[:150] + [f"u{rng.randrange(10**6)}" for _ in range(250)]
        sets = [shingles(" ".join(x), known, 1) for x in (base, near, far)]
        _, sketch = signatures(sets, SETTINGS)
        bits = [int(np.bitwise_count((sketch[0] ^ sketch[k]).view(np.uint64)).sum()) for k in (1, 2)]
        assert bits[0] <= limit < bits[1]  # similarity 0.70 and 0.23


def test_awkward_rows(spark):
    rows = [(2, "a b c d e f", "", "", 0)] * 2 + [(None, "a b c d e f", "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.kept) for r in link_documents(
        frame(spark, rows).selectExpr("*", "1 as rep", "2 as component_id", "3 as a")).collect())
    assert got[1:] == [(2, 2, True), (2, 2, True), (4, 0, True), (5, 0, True)]
    assert link_documents(frame(spark, [])).count() == 0
