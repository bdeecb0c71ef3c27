import random
import zlib
from dataclasses import replace

import numpy as np

from lorekeep.llm.toxicity import SETTINGS, Ftrl, WordHash, features, learnable, score_toxicity, toxicity_digest

from .data import documents, frame

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def labelled(n=1500):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        own = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(20, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["vile", "Foul!", "nasty"])
        docs.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    got = {r.doc_id: r for r in toxicity_digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    right = np.mean([got[i].predicted == labels[i][2] for i in held])
    assert right > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_scores_depend_on_the_text_only(spark):
    docs, labels = labelled(300)
    docs += [(10_000, None), (10_001, ""), (10_002, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as toxic", "'x' as toxicity", "0 as _place")
    got = {r.doc_id: r.toxicity for r in score_toxicity(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert got[10_000] == got[10_001] and got[10_002] == got[0] == got[None]


def test_no_labels_and_repeated_labels(spark):
    df = frame(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.toxicity for r in score_toxicity(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (8, 1, 1), (8, 1, 1)], LABELS)
    assert score_toxicity(df, odd).count() == len(documents())
    assert score_toxicity(df.limit(0), odd).count() == 0
    assert learnable(odd).count() <= 3


def test_l1_keeps_rare_features_at_zero():
    s = replace(SETTINGS, bits=12)
    model, known, rng = Ftrl(s), WordHash(), random.Random(1)
    for _ in range(400):
        toxic = rng.random() < 0.5
        model.learn(features(("bad " if toxic else "") + f"u{rng.random()}", known, s.bits), int(toxic))
    w = model.weights(slice(None))
    assert w[features("bad", known, s.bits)[0]] > 1 and np.count_nonzero(w) < 60
