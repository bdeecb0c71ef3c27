"""Runs polled until they end: latest state, and the outcome within a time budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("COMPLETED", "FAILED")
TIMED_OUT = "TIMED_OUT"

# How long the two pollers wait (120 polls of 1 s, 30 of 10 s).


def latest_state(snapshots: DataFrame, run: str = "run_id", order_by: tuple = ("observed_at",)) -> DataFrame:
    """The last snapshot of every run."""
    rest = [c for c in snapshots.columns if c != run]
    last = snapshots.groupBy(run).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_s"))
    return last.select(run, "_s.*")


def run_outcomes(
    snapshots: DataFrame, budget_seconds: float, delay_seconds: float = 0.0, run: str = "run_id"
) -> DataFrame:
    """Batch twin of the run tracker: one row per run that has ended.

    A run ends in its first terminal state if that came within the budget after
    the first snapshot. Otherwise it is timed out once the newest snapshot of any
    run, less the allowed delay, has passed the deadline.
    """
    state, seen = F.col("state"), F.col("observed_at")
    ended = F.when(state.isin(list(TERMINAL)), F.struct(seen.alias("at"), state.alias("state")))
    per = snapshots.groupBy(run).agg(F.min(seen).alias("started_at"), F.min(ended).alias("_end"))
    budget = F.make_dt_interval(secs=F.lit(budget_seconds))
    delay = F.make_dt_interval(secs=F.lit(delay_seconds))
    clock = snapshots.agg((F.max(seen) - delay).alias("clock")).scalar()
    deadline = F.col("started_at") + budget
    in_time = F.col("_end.at") <= deadline
    outcome = (
        F.when(in_time, F.col("_end.state"))
        .when(F.col("_end").isNotNull() | (clock > deadline), TIMED_OUT)
    )
    return per.select(
        run, outcome.alias("outcome"), "started_at",
        F.when(in_time, F.col("_end.at")).otherwise(deadline).alias("ended_at"),
    ).where(F.col("outcome").isNotNull())
