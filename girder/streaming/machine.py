"""The job machine as a stateful stream: one active job a repository, requests and reports as events, cancellation by a flag that runs out.

Events are (repo, at, seq, kind). CREATE makes a job, or names the active one; an active job that is older than
``STALE`` seconds is failed and replaced. RUNNING, COMPLETED and FAILED move the active job; CANCEL raises its flag, which the next RUNNING
within ``FLAG_TTL`` seconds meets and stops the job. What the state doesn't allow is refused and leaves it alone.

State is kept by repository in RocksDB, in event time: a timer lowers a flag that has run out, so that state doesn't outlive its use.
Events of a repository are expected in order of time from batch to batch; within a batch they are put in order of (at, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "repo long, at timestamp, seq long, kind string"
OUTCOMES = "repo long, seq long, kind string, outcome string, job int, status string"
#: States of an active job, seconds after which it is stale, seconds that a flag holds.
ACTIVE = ("QUEUED", "RUNNING")
STALE, FLAG_TTL = 45, 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

State = tuple[int, str | None, float, float | None]
NEW: State = (0, None, 0.0, None)


def step(state: State, kind: str, at: float) -> tuple[State, str]:
    """The state after an event and what became of it. A state is (job, status, created, flag raised)."""
    job, status, created, flag = state
    active = status in ACTIVE
    if kind == "CREATE":
        if active and at - created <= STALE:
            return state, "EXISTING"
        return (job + 1, "QUEUED", at, None), "REPLACED" if active else "CREATED"
    if not active or (kind == "COMPLETED" and status != "RUNNING"):
        return state, "REFUSED"
    if kind == "CANCEL":
        return (job, status, created, at), "FLAGGED"
    if kind == "RUNNING" and flag is not None and at - flag < FLAG_TTL:
        return (job, "CANCELLED", created, None), "STOPPED"
    return (job, kind, created, flag if kind == "RUNNING" else None), "MOVED"


class Machine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("job", "job int, status string, created double, flag double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state: State = tuple(self.jobs.get()) if self.jobs.exists() else NEW
        flag, out = state[3], []
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, seq, kind in zip(events["at"], events["seq"], events["kind"], strict=True):
            state, outcome = step(state, kind, at.timestamp())
            out.append((key[0], seq, kind, outcome, state[0], state[1]))
        self.jobs.update(state)
        if state[3] is not None and state[3] != flag:
            self.handle.registerTimer(int((state[3] + FLAG_TTL) * 1000))
        yield pd.DataFrame(out, columns=["repo", "seq", "kind", "outcome", "job", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, status, created, flag = self.jobs.get() if self.jobs.exists() else NEW
        if flag is not None and (flag + FLAG_TTL) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.jobs.update((job, status, created, None))
        return iter([])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame) -> DataFrame:
    """``OUTCOMES``: a row for each event of a stream, for the append mode."""
    return events.withWatermark("at", "0 seconds").groupBy("repo").transformWithStateInPandas(Machine(), OUTCOMES, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB, which timers need, for streams begun within."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def arrive(events: DataFrame, folder: str, slices: int, at: str = "at") -> None:
    """Writes events as files that arrive one after the other, in order of time."""
    ends = [x[0] for x in events.select(F.explode(F.percentile_approx(F.unix_micros(at), F.array(*[F.lit(k / slices) for k in range(1, slices)]), 1000))).collect()] if slices > 1 else []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = events
        if low is not None:
            part = part.where(F.unix_micros(at) > low)
        if high is not None:
            part = part.where(F.unix_micros(at) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)


def run(spark: SparkSession, events: str, out: str, state: str, files_a_batch: int = 1) -> DataFrame:
    """Runs the machine over the files that lie in ``events`` and goes on where ``state`` says that it stopped; all outcomes so far."""
    with rocksdb(spark):
        read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(events)
        outcomes(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTCOMES).parquet(out)
