import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.llm.slot_shards import Settings, dealt, grown, read_map, rebalanced, shard_digest, shard_records, write_version
from tests.llm.data import DOC_SCHEMA, documents, frame


def checked(rows, got, shards=16):
    """Sizes, checksums and gapless places; bytes per shard."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    places: dict[int, list[int]] = {}
    loads = Counter()
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert set(places) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return [loads[s] for s in range(shards)]


def test_documents(spark):
    rows = documents()
    got = shard_digest(frame(spark)).collect()
    loads = checked(rows, got)
    # The largest document alone is more than a fair share; without it the rest is near equal.
    assert max(loads) == max(len((t or "").encode()) for _, t, *_ in rows) + 1
    again = shard_digest(frame(spark).repartition(7)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_many_documents_are_near_equal(spark):
    rows = [(i, "x" * (i * 7919 % 3000), "en", "s", 0) for i in range(4000)]
    loads = checked(rows, shard_digest(frame(spark, rows)).collect())
    assert max(loads) - min(loads) <= 0.001 * sum(loads) / 16 + 1


def test_a_third_under_one_key_and_null_ids(spark):
    rows = [(7, "same text" * 20, "en", "s", 0)] * 1000 + [(None, None, "en", None, 0)] * 500 + [
        (i, "y" * (i % 400), "fr", "t", 0) for i in range(2000)]
    loads = checked(rows, shard_digest(frame(spark, rows)).collect())
    assert max(loads) < 1.02 * min(loads)


def test_hot_slots_are_numbered_in_parts(spark):
    rows = [(1, "a", "en", "s", 0)] * 300
    settings = Settings(shards=3, slots=4, slot_rows=20)
    checked(rows, shard_digest(frame(spark, rows), settings).collect(), 3)


def test_empty_and_clashing_columns(spark):
    assert shard_digest(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    df = frame(spark).selectExpr("*", "1 AS size", "2 AS Shard", "3 AS slot", "4 AS virtual_slot", "5 AS part", "6 AS lk_row", "7 AS lk_nth",
                                 "8 AS bytes", "9 AS version", "10 AS n")
    assert shard_digest(df).count() == len(documents())
    out = shard_records(df, F.col("n_chars"), ["doc_id"])
    assert [r.bytes for r in out.select("bytes").distinct().collect()] == [8]
    assert out.agg(F.sum("size")).first()[0] == sum(r[4] for r in documents())


def test_map_versions(spark, tmp_path):
    path = f"{tmp_path}/map"
    slots = [(v, 0) for v in range(200)]
    loads = {(v, 0): 10 + v * v % 97 for v in range(200)}
    first = dealt(slots, 4)
    write_version(spark, path, 0, first, {})
    edits = rebalanced(first, loads, 4, 0.001)
    write_version(spark, path, 1, edits, {})
    now = first | edits
    more = grown(now, loads, 4, 0.001)
    write_version(spark, path, 2, more, {})

    def at(version):
        return {(r.virtual_slot, r.part): r.shard for r in read_map(spark, path, version).collect()}

    assert at(0) == first and at(1) == now and at(2) == at(None) == now | more
    assert 0 < len(edits) < 60
    assert set(more.values()) == {4}


@pytest.mark.parametrize("shards", [1, 2, 16])
def test_rebalance_of_awkward_loads(shards):
    for loads in ({}, {(0, 0): 5}, {(v, 0): 0 for v in range(40)}, {(v, 0): 10**12 if v == 3 else v for v in range(300)}):
        first = dealt(loads, shards)
        now = first | rebalanced(first, loads, shards, 0.001)
        total = Counter({s: 0 for s in range(shards)})
        for slot, n in loads.items():
            total[now[slot]] += n
        rest = sorted(total.values())[:-1]
        assert not rest or rest[-1] - rest[0] <= max(2, 0.002 * sum(rest) / len(rest)) or len(loads) < shards
