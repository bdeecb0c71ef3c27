"""Follow runs until they complete, fail, or use up their time budget."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import TERMINAL, TIMED_OUT

BRIEF = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("first_us", T.LongType()),
    T.StructField("end_us", T.LongType()),
    T.StructField("end_state", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
])
OUTCOME = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
])
STATE = T.StructType([
    T.StructField("first_us", T.LongType()),
    T.StructField("closed", T.BooleanType()),
])


def brief_snapshots(snapshots: DataFrame) -> DataFrame:
    """Reduce snapshots to one row per run and Arrow batch, before the shuffle.

    The tracker only needs the first time and the first terminal state of a run.
    A run that is polled all day then costs a row per task, not a row per poll.
    """
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["us", "state"], kind="stable")
            runs = rows.groupby("run_id", sort=False)["us"].agg(first_us="min", last_us="max")
            ended = rows[rows["state"].isin(TERMINAL)].groupby("run_id", sort=False).first()
            runs["end_us"] = ended["us"].astype("Int64")
            runs["end_state"] = ended["state"]
            runs["observed_at"] = pd.to_datetime(runs["last_us"], unit="us", utc=True)
            out = runs.reset_index()[BRIEF.names]
            yield out.astype({"end_us": "Int64"})

    us = F.unix_micros(F.col("observed_at").cast("timestamp"))
    return snapshots.select("run_id", "state", us.alias("us")).where(
        F.col("run_id").isNotNull() & F.col("us").isNotNull()
    ).mapInPandas(reduce, BRIEF)


def track_runs(
    snapshots: DataFrame, budget_seconds: float, delay: str = "0 seconds",
    keep_closed_seconds: float = 3600.0,
) -> DataFrame:
    """One row per run: COMPLETED, FAILED, or TIMED_OUT after ``budget_seconds``.

    ``snapshots`` is a stream of run_id, state, observed_at. Time is event time: a
    run times out when the watermark passes its deadline, which needs newer
    snapshots of any run. A closed run is remembered for ``keep_closed_seconds``
    past its deadline, and its later snapshots are ignored.
    """
    budget_us = int(budget_seconds * 1_000_000)
    keep_ms = int(keep_closed_seconds * 1000)

    def outcome(key: tuple, kind: str, first: int, end: int) -> pd.DataFrame:
        return pd.DataFrame({
            "run_id": [key[0]], "outcome": [kind],
            "started_at": pd.to_datetime([first], unit="us", utc=True),
            "ended_at": pd.to_datetime([end], unit="us", utc=True),
        })

    def close(state: GroupState, first: int) -> None:
        state.update((first, True))
        forget = (first + budget_us) // 1000 + keep_ms
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, closed = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            close(state, first)
            yield outcome(key, TIMED_OUT, first, first + budget_us)
            return
        end = None
        for rows in batches:
            seen = int(rows["first_us"].min())
            first = seen if first is None else min(first, seen)
            done = rows.dropna(subset=["end_us"])
            if len(done):
                at = done.sort_values(["end_us", "end_state"]).iloc[0]
                found = (int(at["end_us"]), at["end_state"])
                end = found if end is None else min(end, found)
        if closed:
            close(state, first)
            return
        deadline = first + budget_us
        if end is not None:
            close(state, first)
            if end[0] <= deadline:
                yield outcome(key, end[1], first, end[0])
            else:
                yield outcome(key, TIMED_OUT, first, deadline)
            return
        state.update((first, False))
        # A deadline the watermark has passed already fires with the next batch.
        state.setTimeoutTimestamp(max(deadline // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return (
        brief_snapshots(snapshots).withWatermark("observed_at", delay).groupBy("run_id")
        .applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


CLOSING = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("first_us", T.LongType()),
    T.StructField("end_us", T.LongType()),
])
OPEN = T.StructType([
    T.StructField("first_us", T.LongType()),
    T.StructField("due_ms", T.LongType()),
])
CLOSED = T.StructType([T.StructField("closed", T.BooleanType())])


class RunClock(StatefulProcessor):
    """A run's first time and the timer of its deadline; closed runs are forgotten by their time to live."""

    def __init__(self, budget_us: int, grace_ms: int, keep_ms: int):
        self.budget_us, self.grace_ms, self.keep_ms = budget_us, grace_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.closed = handle.getValueState("closed", CLOSED, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, due = self.open.get() if self.open.exists() else (None, None)
        known, end = first, None
        for r in rows:
            first = r.first_us if first is None else min(first, r.first_us)
            if r.end_us is not None:
                end = (r.end_us, r.end_state) if end is None else min(end, (r.end_us, r.end_state))
        if self.closed.exists():
            return
        if end is not None:
            deadline = first + self.budget_us
            yield self._close(key, first, due, *(end if end[0] <= deadline else (deadline, TIMED_OUT)))
        elif first != known:
            if due is not None:
                self.handle.deleteTimer(due)
            now = timerValues.getCurrentProcessingTimeInMs()
            due = max((first + self.budget_us) // 1000, now) + 1 + self.grace_ms
            self.handle.registerTimer(due)
            self.open.update((first, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            first, _ = self.open.get()
            yield self._close(key, first, None, first + self.budget_us, TIMED_OUT)

    def _close(self, key, first: int, due: int | None, end: int, outcome: str) -> Row:
        if due is not None:
            self.handle.deleteTimer(due)
        self.open.clear()
        self.closed.update((True,))
        return Row(run_id=key[0], outcome=outcome, first_us=first, end_us=end)

    def close(self) -> None:
        pass


def track_live_runs(
    snapshots: DataFrame, budget_seconds: float, grace_seconds: float = 0.0, keep_closed_seconds: float = 3600.0,
) -> DataFrame:
    """The tracker by the wall clock: a run times out although no run sends anything any more.

    A timer stands at the deadline, ``budget_seconds`` after the run's first snapshot, plus
    ``grace_seconds`` for snapshots on their way; one that comes before the timer has
    fired still counts by its own time. A closed run is remembered for ``keep_closed_seconds``.
    Timers and states live in the checkpoint, so a restart goes on with them. Rows without a run or
    a time are left out. Needs the RocksDB state store (``with_rocksdb``).
    """
    clock = RunClock(int(budget_seconds * 1_000_000), int(grace_seconds * 1000), int(keep_closed_seconds * 1000))
    closing = brief_snapshots(snapshots).groupBy("run_id").transformWithState(clock, CLOSING, "Append", "ProcessingTime")
    return closing.select(
        "run_id", "outcome", F.timestamp_micros("first_us").alias("started_at"), F.timestamp_micros("end_us").alias("ended_at"))


def with_rocksdb(spark) -> None:
    """Streams that start from now on keep their states in RocksDB, as timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_until_quiet(query: StreamingQuery, wait_seconds: float = 0.2) -> None:
    """Stop a stream after its first batch without input, in which the timers that were due have fired."""
    try:
        while query.isActive and not any(p["numInputRows"] == 0 for p in query.recentProgress):
            time.sleep(wait_seconds)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
