"""Study selection from a table: same rows as literal matching, a plan of constant size."""

import random

import pytest

from lorekeep.operators.many_studies import matcher, select_many_studies
from lorekeep.operators.studies import select_studies


def table(spark, studies):
    return spark.createDataFrame([(s, t) for s, terms in studies.items() for t in terms], "study string, term string")


def docs_of(spark, n=60):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC d") for _ in range(rng.randrange(40))) for _ in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "İstanbul PD-1")], "doc long, text string")


@pytest.mark.parametrize("part_bytes, block_terms", [(2_000_000, 1000), (40, 1000), (40, 1)])
def test_as_literal_matching(spark, rows, part_bytes, block_terms):
    rng = random.Random(4)
    studies = {f"s{i}": ["".join(rng.choice("ABc d") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
               for i in range(40)}
    studies |= {"twice": ["ab", "AB"], "inner": ["abc", "b"], "long": ["zzz" * 50], "pd": ["pd-1"]}
    docs = docs_of(spark)
    for retmax in (None, 3):
        got = select_many_studies(docs, table(spark, studies), "doc", retmax=retmax, part_bytes=part_bytes, block_terms=block_terms)
        assert rows(got) == rows(select_studies(docs, studies, "doc", retmax=retmax))


def test_nulls_and_empty(spark, rows):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (None, "b")], "doc int, text string")
    studies = spark.createDataFrame(
        [("all", ""), ("b", "B"), ("b", "b"), ("void", "b"), ("void", None), (None, "b")], "study string, term string")
    assert rows(select_many_studies(docs, studies, "doc", retmax=None)) == [
        ("all", 1), ("all", 2), ("all", None), ("b", 1), ("b", None)]
    assert rows(select_many_studies(docs, studies.limit(0), "doc")) == []
    assert rows(select_many_studies(docs.limit(0), studies, "doc")) == []


def test_plan_does_not_grow_with_the_studies(spark):
    docs = docs_of(spark)
    sizes = []
    for n in (2, 2000):
        found = select_many_studies(docs, table(spark, {f"s{i}": [f"a{i}", "b"] for i in range(n)}), "doc")
        sizes.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_hits_of_many_rows_are_cut_into_batches(spark):
    docs = spark.range(400).selectExpr("id AS doc", "'common words' AS text")
    found = select_many_studies(docs, table(spark, {f"s{i}": ["common"] for i in range(300)}), "doc", retmax=None)
    assert found.count() == found.distinct().count() == 400 * 300


def test_matcher_without_terms():
    assert matcher([])("text") == []
    assert matcher([("s", 1, [""])])("text") == [0]
