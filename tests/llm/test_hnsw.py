from dataclasses import replace

import numpy as np
import pytest

from lorekeep.llm.hnsw import SETTINGS, Graph, forest, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
SMALL = replace(SETTINGS, shard_rows=60, batch=32, audit=32)


def brute(rows):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows
            if lab is not None and i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for i, v, lab in good:
        for j, w, lab2 in good:
            if i != j and lab == lab2 and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for label in (0, 1):
        centres = rng.normal(size=(40, 16))
        for k in range(260):
            noise = 0.0 if k % 5 == 0 else rng.uniform(0.01, 0.25)
            c = centres[0] if k < 90 else centres[rng.integers(40)]
            out.append((c + noise * rng.normal(size=16)).astype(np.float32).tolist() + [label])
    rows = [(i * 3, v[:-1], v[-1]) for i, v in enumerate(out)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0] * 8, [2.0] * 8]
    return rows + [(10_000 + i, v, 0) for i, v in enumerate(odd)] + [(20_000, out[0][:-1], None)]


def test_links_and_components_match_brute_force(spark, rows):
    want = brute(rows)
    got = {r.vec_id: tuple(r)[1:] for r in link_vectors(spark.createDataFrame(rows, SCHEMA), SMALL).collect()}
    assert set(got) == set(want)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] != want[i][1:] for i in want) == 0


def test_graph_finds_what_brute_force_finds():
    x = np.random.default_rng(2).normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Graph.build(x, SETTINGS)
    assert len(g.layers) > 1
    ids, _ = g.search(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([np.isin(t, i).mean() for t, i in zip(true, ids)]) > 0.9


def test_forest():
    assert forest(np.array([4, 2]), np.array([3, 4]), 6).tolist() == [0, 1, 2, 2, 2, 5]
    assert forest(np.zeros(0, int), np.zeros(0, int), 0).tolist() == []


def test_empty_and_copies(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(i, [1.0, 2.0], 3) for i in range(5)], SCHEMA).selectExpr("*", "1 as component_id", "2 as rep")
    assert sorted(tuple(r) for r in link_vectors(df).collect()) == [(i, 4, 0, i == 0) for i in range(5)]
