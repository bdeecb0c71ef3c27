import hashlib
import math

import numpy as np
import pytest

from lorekeep.llm.drift_kmeans import (
    SETTINGS, Settings, assigned, cluster_digest, cluster_vectors, fall_within, moved, squares, whole,
)

SCHEMA = "vec_id long, embedding array<float>, label int"
SMALL = Settings(clusters=5, dims=6)


def brute(rows, s):
    """Every vector against every centroid, in Python's integers."""
    def ints(v):
        return tuple(math.floor(s.scale * x) if abs(x) < 2.0**53 else int(x) * s.scale for x in v)

    kept = [(i, ints(v)) for i, v in rows
            if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{s.seed}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    cents = [q for _, q in start[:s.clusters]]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(s.rounds):
        got = assign()
        for c in range(len(cents)):
            mine = [q for (_, q), (a, _) in zip(kept, got) if a == c]
            if mine:
                cents[c] = tuple(sum(col) // len(mine) for col in zip(*mine))
    got = assign()
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    per = [sum(d for a, d in got if a == c) for c in range(len(cents))]
    fit = lambda v: v if v < 2**63 else None
    return [(i, a, fit(d), fit(per[a]), fit(sum(per)), name[a]) for (i, _), (a, d) in zip(kept, got)]


def vectors(n, dims, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    x = centres[rng.integers(7, size=n)] + spread * rng.normal(size=(n, dims))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def same(spark, rows, s, schema="vec_id long, embedding array<float>"):
    got = [tuple(r) for r in cluster_digest(spark.createDataFrame(rows, schema), s).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, s), key=repr)


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_matches_brute_force(spark, spread):
    same(spark, vectors(700, 64, spread=spread), SETTINGS)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 6) + vectors(20, 6) + [(100 + i, [1.0] * 6) for i in range(30)]
    rows += [(200, None), (201, []), (202, [nan] + [0.0] * 5), (203, [-inf] + [0.0] * 5), (204, [None] + [0.0] * 5),
             (205, [1.0] * 7), (None, [0.5] * 6), (None, [0.5] * 6), (206, [1.0] * 5000)]
    same(spark, rows, SMALL)


def test_huge_components_count_exactly(spark):
    rows = vectors(40, 6) + [(50, [3e38] * 6), (51, [-3e38] + [1.0] * 5), (52, [1e9] * 6), (53, [7e4, 1.0, 1.0, 1.0, 1.0, 1.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    same(spark, rows, SMALL)
    rows += [(54, [1e308] * 6), (55, [-1e300] * 6)]
    same(spark, rows, SMALL, "vec_id long, embedding array<double>")


def test_ties_few_rows_and_empty(spark):
    same(spark, [(i, [1.0] * 6) for i in range(9)], SMALL)
    same(spark, [(1, [1.0] * 6), (2, [2.0] * 6)], SMALL)
    empty = cluster_digest(spark.createDataFrame([], "vec_id long, embedding array<float>"), SMALL)
    assert empty.count() == 0
    assert dict(empty.dtypes) == dict(cluster_digest(spark.createDataFrame(vectors(9, 6), SCHEMA.replace(", label int", "")), SMALL).dtypes)


def test_clashing_columns_pass_through(spark):
    rows = vectors(50, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS row", "2 AS upper", "'x' AS `Cluster`", "3 AS lower", "4 AS h", "5 AS e", "6 AS `a.b`", "7 AS full")
    out, _, _ = cluster_vectors(df, SMALL)
    assert sorted(c.lower() for c in out.columns) == sorted(
        ["vec_id", "embedding", "row", "upper", "lower", "h", "e", "a.b", "full", "cluster", "distance", "scans"])
    assert sorted((r["vec_id"], r["cluster"]) for r in out.collect()) == [b[:2] for b in brute(rows, SMALL)]


def test_the_planar_bound_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(60):
        own, old = rng.normal(size=(2, 8)) * 4
        new, radius = old + rng.normal(size=8) * rng.uniform(0, 2), rng.uniform(0, 3)
        bound = fall_within(own, radius, old, new, 256)
        way = np.linalg.norm(new - old)
        u = rng.normal(size=(4000, 8))
        x = own + radius * u / np.linalg.norm(u, axis=1)[:, None] * rng.uniform(0, 1, size=(4000, 1)) ** 0.1
        # The plane of the three centres holds the worst points.
        a, b = old - own, new - own
        basis = np.linalg.qr(np.stack([a, b], axis=1))[0]
        turn = np.linspace(0, 2 * np.pi, 2000)
        ring = own + radius * (np.stack([np.cos(turn), np.sin(turn)], axis=1) @ basis.T)
        for points in (x, ring):
            fall = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
            assert fall.max() <= bound + 1e-9
        assert bound <= way + 1e-12
        worst = (np.linalg.norm(ring - old, axis=1) - np.linalg.norm(ring - new, axis=1)).max()
        assert bound <= max(0, worst) + 0.05 * way + 0.05
        less += bound < 0.7 * way
    assert less > 20


def test_bounds_spare_scans_and_change_nothing():
    x = np.array([v for _, v in vectors(3000, 16, seed=3, spread=0.1)])
    s = Settings(clusters=7, dims=16)
    q = whole(x, s.scale)
    old = [[int(v) for v in q[i]] for i in range(7)]
    state = assigned(x, None, old, None, s.scale)
    for _ in range(3):
        new = [[int(v) for v in np.floor(q[state[0] == c].mean(0))] if (state[0] == c).any() else old[c] for c in range(7)]
        radii = [float(state[1][state[0] == c].max(initial=0)) for c in range(7)]
        state = assigned(x, state, new, moved(old, new, radii, s.strips), s.scale)
        assert (state[0] == np.argmin(squares(q, new), axis=1)).all()
        old = new
    assert state[3].mean() < 3
