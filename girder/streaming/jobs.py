"""Structured Streaming forms of job progress: event log, latest state, state machine, audit chains.

Events are (job_id, ts, kind, percent). The state machine allows QUEUED to RUNNING and RUNNING to an end;
anything else is rejected; a job without events for ``STALE`` is failed by a timer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job_id long, ts timestamp, kind string, percent int"
#: Allowed transitions and the limits in milliseconds.
NEXT = {None: {"QUEUED"}, "QUEUED": {"RUNNING", "FAILED", "CANCELLED"}, "RUNNING": {"RUNNING", "COMPLETED", "FAILED", "CANCELLED"}, "COMPLETED": set(), "FAILED": set(), "CANCELLED": set()}
STALE = 45 * 60 * 1000


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def publish(events: DataFrame, folder: str) -> None:
    """Appends progress events as JSON rows."""
    events.write.mode("append").json(folder)


def latest_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest event of each job, for the update or complete output mode."""
    return events.withWatermark("ts", delay).groupBy("job_id").agg(F.max_by("kind", "ts").alias("state"), F.max_by("percent", "ts").alias("percent"), F.max("ts").alias("at"))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, state, percent, accepted, rejected) whenever a job's state changes or times out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (now, percent, accepted, rejected) = state.get
            state.remove()
            if now in ("QUEUED", "RUNNING"):
                yield pd.DataFrame([(key[0], "FAILED", percent, accepted, rejected)], columns=["job_id", "state", "percent", "accepted", "rejected"])
            return
        now, percent, accepted, rejected = state.get if state.exists else (None, 0, 0, 0)
        for row in pd.concat(list(batches)).sort_values(["ts", "percent"]).itertuples():
            if row.kind in NEXT[now]:
                now, percent, accepted = row.kind, int(row.percent), accepted + 1
            else:
                rejected += 1
        state.update((now, percent, accepted, rejected))
        state.setTimeoutDuration(STALE)
        yield pd.DataFrame([(key[0], now, percent, accepted, rejected)], columns=["job_id", "state", "percent", "accepted", "rejected"])

    out = "job_id long, state string, percent int, accepted int, rejected int"
    return events.groupBy("job_id").applyInPandasWithState(step, out, "state string, percent int, accepted int, rejected int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def audit_chains(events: DataFrame) -> DataFrame:
    """(job_id, ts, prev_hash, event_hash): each job's events chained by hash, across micro-batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get[0] if state.exists else "0" * 64
        rows = []
        for row in pd.concat(list(batches)).sort_values(["ts", "percent"]).itertuples():
            h = hashlib.sha256(f"{key[0]}|{row.ts.isoformat()}|{row.kind}|{row.percent}|{prev}".encode()).hexdigest()
            rows.append((key[0], row.ts, prev, h))
            prev = h
        state.update((prev,))
        yield pd.DataFrame(rows, columns=["job_id", "ts", "prev_hash", "event_hash"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, ts timestamp, prev_hash string, event_hash string", "prev string", "append", GroupStateTimeout.NoTimeout)


def cancelled(events: DataFrame, ttl: str = "3600 seconds") -> DataFrame:
    """Jobs cancelled within the last ttl of event time."""
    return events.where("kind = 'CANCELLED'").withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["job_id"]).select("job_id", "ts")
