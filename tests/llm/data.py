"""Small awkward inputs."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    """Nulls, empty and long texts, ties, exact and near copies, shared passages, several scripts."""
    rng = random.Random(3)
    rows, base = [], [words(rng, 120) for _ in range(6)]
    passage = " ".join(words(rng, 70, 5000))
    for i, own in enumerate(base):
        rows.append(" ".join(own))
        near = list(own)
        near[5 + i] = "changed"
        rows.append(" ".join(near))
        rows.append(" ".join(own).upper())
        far = list(own)
        for k in range(0, 120, 8):
            far[k] = f"other{k}{i}"
        rows.append(" ".join(far))
    rows += [None, "", "   \n", "one two", "one two", "one two three four five", "é ü ñ 日本語 ß"]
    rows += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}" for _ in range(4)]
    rows += ["ab" * 600, "aaaa " * 300, " ".join(words(rng, 9000, 3000)), "é" * 450, "x" * 199, "y" * 200, "z" * 201]
    rows += ["Licensed under CC BY 4.0. All rights reserved.", "GNU General Public License general public license"]
    sources = ["a", "b", None, "c", "b", "a", "a"]
    return [(i * 7 + 1, t, "en", sources[i % 7], len(t) if t else 0) for i, t in enumerate(rows)]


def frame(spark, rows=None, schema=DOC_SCHEMA):
    return spark.createDataFrame(documents() if rows is None else rows, schema)
