"""Every registered query: same rows as its SQL, and a plan that scales."""

import re

import pytest

from __spark_entry__ import entry, queries
from lorekeep.plans.registry import ORACLES, QUERIES
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("s")}
WRITES = {"q05c_corpus_rewrite", "q05d_corpus_bucketed", "q19b_two_column_lines"} | STREAMS | {n for n in QUERIES if n.startswith("r")}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"domain", "articles", "touched"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_plan(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ExistingRDD"):
        assert node not in plan
    # A window without a partition column: only over one row per range.
    for window in re.findall(r"Window \[.*\](?:, \[.*\])?", plan):
        spec = re.search(r"windowspecdefinition\((.*?)specifiedwindowframe", window).group(1)
        first = spec.split(",")[0]
        if " ASC" in first or " DESC" in first:
            assert "_range" in first, window
