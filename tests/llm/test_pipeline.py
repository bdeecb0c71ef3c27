"""The stages against brute force on a small table."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lorekeep.session import work_dir

from . import test_odd_sketch, test_suffix_dedup
from .data import DOC_SCHEMA, documents


@pytest.fixture(scope="module")
def home(spark):
    rng, rows, labels = random.Random(5), documents(), []
    for i in range(900):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(10, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            own[rng.randrange(len(own))] = "vile"
        rows.append((5000 + i, " ".join(own), "en", f"s{i % 4}", 0))
        labels.append((5000 + i, 1, toxic))
    path = work_dir(spark, "pipeline-test")
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage(spark, home):
    docs = spark.read.parquet(f"{home}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, steps[-1], home).write.parquet(f"{home}/out/{name}")
        steps.append(spark.read.parquet(f"{home}/out/{name}"))
    assert all(s.columns == columns for s in steps[:-1])
    start, clean, lone, cut, mixed, packed = ([tuple(r) for r in s.collect()] for s in steps)

    vile = {r[0] for r in start if "vile" in (r[1] or "")}
    kept = {r[0] for r in clean}
    assert len(vile - kept) >= 0.95 * len(vile) and len({r[0] for r in start} - vile - kept) <= 0.01 * len(start)

    want = test_odd_sketch.brute(clean)
    assert Counter(r[0] for r in lone) == Counter(d for d, (_, _, k) in want.items() if k)

    removed = {d: n for d, _, n, *_ in test_suffix_dedup.brute(lone)}
    after = {r[0]: r for r in cut}
    assert set(after) == set(removed)
    for doc, text, *_ in lone:
        if not removed[doc]:
            assert after[doc][1] == text
        else:
            assert len((after[doc][1] or "").encode()) <= len(text.encode()) - removed[doc] and after[doc][4] == len(after[doc][1])

    assert max(Counter(r[0] for r in mixed).values()) <= 3 and set(mixed) <= set(cut)
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert abs(count(mixed) - count(cut)) < 0.05 * count(cut) + 9000
    assert Counter(p[0] for p in packed if p[1] == 0) == Counter(r[0] for r in mixed)


def test_run_gives_the_last_stage(spark, home):
    assert pipeline.run(spark, home).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert pipeline.ORACLE_SQL is None
