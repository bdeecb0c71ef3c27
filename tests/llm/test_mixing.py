import random
import re
from collections import Counter, defaultdict

import numpy as np

from lorekeep.llm.mixing import drawn, mix_digest, mix_sources, source_targets, split_quotas

from .data import DOC_SCHEMA, documents, frame


def targets(sizes):
    """Water filling, round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1.0 for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, "é": 1000, None: 5}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 100, "d": 3, "e": 0}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_digest(spark):
    rng = random.Random(1)
    rows = documents() + [(10_000 + i, "w " * rng.randrange(1, 60), "en", rng.choice(["big"] * 6 + ["b", "c"]), 0) for i in range(900)]
    rows += [rows[-1]] * 3
    got = mix_digest(frame(spark, rows)).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, n) for (d, *_), n in zip(rows, size))
    by = defaultdict(int)
    for (_, _, _, s, _), n in zip(rows, size):
        by[s] += n
    want = targets(dict(by))
    source = {d: s for d, _, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = {s: max(n for (_, _, _, x, _), n in zip(rows, size) if x == s) for s in by}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in by)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_digest(frame(spark, rows).repartition(7)).collect()))


def test_quotas_add_up_and_leaves_are_disjoint():
    quotas = np.array([5, 0, 40, 3])
    for shards in (1, 2, 5, 8):
        at = np.zeros(4, int)
        for leaf in range(shards):
            have, before = split_quotas(quotas, shards, leaf, 3)
            assert (before == at).all()
            at += have
            assert abs(have.sum() - quotas.sum() / shards) <= 2
        assert (at == quotas).all()


def test_shards_and_positions(spark):
    rows = [(i, "w " * 20, "en", "ab"[i % 2], 0) for i in range(400)]
    got = mix_sources(frame(spark, rows), block_words=200, shard_words=2000).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.mix_shard].append(r.mix_position)
    assert len(shards) == 4 and all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())
    assert len({(r.doc_id, r.mix_copy) for r in got}) == len(got)


def test_clashing_and_empty(spark):
    df = frame(spark).selectExpr("*", "1 as mix_size", "2 as target", "3 as _block", "4 as n")
    df = df.selectExpr("*", "5 as _salt", "6 as _pick", "7 as _nth", "8 as row", "9 as `a.b`", "10 as mix_salt", "11 as _middle", "12 as _src")
    got = mix_sources(df).collect()
    assert got and all((r["_block"], r["_salt"], r["_pick"], r["_nth"], r["row"], r["a.b"], r["mix_salt"], r["_src"]) == (3, 5, 6, 7, 8, 9, 10, 12)
                       for r in got)
    assert mix_digest(frame(spark, [])).count() == 0 and mix_sources(frame(spark, [(1, None, "", "a", 0)], DOC_SCHEMA)).count() == 0


def test_draws_beyond_what_numpy_takes_at_once():
    rng = np.random.default_rng(4)
    for have in ([3 * 10**9, 0, 5, 7 * 10**9], [10**13, 10**12, 1], [4, 4]):
        have = np.array(have)
        for want in (0, 1, int(have.sum()) // 3, int(have.sum())):
            got = drawn(have, want, rng)
            assert got.sum() == want and (got >= 0).all() and (got <= have).all()
    small = drawn(np.array([50, 30, 0, 20]), 40, rng, most=11)
    assert small.sum() == 40 and (small <= [50, 30, 0, 20]).all()
    have, before = split_quotas(np.array([6 * 10**9, 5 * 10**9]), 3, 1, 2)
    assert abs(have.sum() - 11 * 10**9 // 3) <= 2 and (before > 0).all()
