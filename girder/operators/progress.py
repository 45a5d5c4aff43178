"""Progress of jobs over the conversations' turns: published and read back as rows, states, stages, cancellation; batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import Dialect, native, operator, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View
from girder.streaming import jobs, machine, trail

#: The stages of an analysis with their percent, in order.
STAGES = (("ingestion", 5), ("parsing", 20), ("dependencies", 35), ("architecture", 50), ("callgraph", 60), ("dataflow", 75), ("security", 85), ("compliance", 92), ("health", 97))
VIEWS["job_events"] = View(
    ("turns",),
    """
SELECT conv_id AS job_id, turn, CASE WHEN turn = 0 THEN 'QUEUED' WHEN turn = 1 THEN 'RUNNING' WHEN role = 'user' AND conv_id % 3 = 0 THEN 'CANCELLED' WHEN role = 'user' AND conv_id % 3 = 1 THEN 'FAILED' WHEN role = 'user' THEN 'COMPLETED' ELSE 'RUNNING' END AS kind,
       CAST(least(100, turn * 10) AS INT) AS percent FROM {turns}""".strip(),
)


#: Requests and reports about the jobs of a repository, three conversations each: first turns ask for a job, answers report work, other turns ask or end by their length.
VIEWS["job_requests"] = View(
    ("turns",),
    """
SELECT CAST(floor(conv_id / 3) AS BIGINT) AS repo, 1700000000 + CAST(floor(conv_id / 3) AS BIGINT) * 5 + (conv_id - CAST(floor(conv_id / 3) AS BIGINT) * 3) * 70 + turn * 20 AS second, conv_id * 1000 + turn AS seq,
       CASE WHEN turn = 0 THEN 'CREATE' WHEN role = 'assistant' THEN 'RUNNING' WHEN length(text) < 150 THEN 'CANCEL' WHEN length(text) < 250 THEN 'CREATE' WHEN length(text) < 400 THEN 'COMPLETED' ELSE 'FAILED' END AS kind
FROM {turns}""".strip(),
)

#: The ordered fold of each repository's events.
_FOLD = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY second, seq) AS k FROM {{job_requests}}),
f AS (
  SELECT repo, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, 0 AS job, ''::VARCHAR AS status, 0::BIGINT AS created, NULL::BIGINT AS flag FROM (SELECT DISTINCT repo FROM e)
  UNION ALL
  SELECT repo, k, seq, kind, outcome, CASE WHEN outcome IN ('CREATED', 'REPLACED') THEN job + 1 ELSE job END,
         CASE outcome WHEN 'CREATED' THEN 'QUEUED' WHEN 'REPLACED' THEN 'QUEUED' WHEN 'STOPPED' THEN 'CANCELLED' WHEN 'MOVED' THEN kind ELSE status END,
         CASE WHEN outcome IN ('CREATED', 'REPLACED') THEN second ELSE created END,
         CASE outcome WHEN 'FLAGGED' THEN second WHEN 'EXISTING' THEN flag WHEN 'REFUSED' THEN flag WHEN 'MOVED' THEN CASE WHEN kind = 'RUNNING' THEN flag END END
  FROM (SELECT e.repo, e.k, e.seq, e.kind, e.second, f.job, f.status, f.created, f.flag,
               CASE WHEN e.kind = 'CREATE' AND f.status IN ('QUEUED', 'RUNNING') AND e.second - f.created <= {machine.STALE} THEN 'EXISTING'
                    WHEN e.kind = 'CREATE' AND f.status IN ('QUEUED', 'RUNNING') THEN 'REPLACED' WHEN e.kind = 'CREATE' THEN 'CREATED'
                    WHEN f.status NOT IN ('QUEUED', 'RUNNING') OR (e.kind = 'COMPLETED' AND f.status <> 'RUNNING') THEN 'REFUSED' WHEN e.kind = 'CANCEL' THEN 'FLAGGED'
                    WHEN e.kind = 'RUNNING' AND e.second - f.flag < {machine.FLAG_TTL} THEN 'STOPPED' ELSE 'MOVED' END AS outcome
        FROM f JOIN e ON e.repo = f.repo AND e.k = f.k + 1) x
) SELECT repo, seq, kind, outcome, job, status FROM f WHERE k > 0"""


def job_stream(spark: SparkSession, sf_dir: str, slices: int = 4) -> DataFrame:
    """What became of each event, by the stateful stream over files that arrive in order of time."""
    scratch = Scratch(spark, "jobs")
    requests = view(spark, sf_dir, "job_requests").select("repo", F.timestamp_seconds("second").alias("at"), "seq", "kind")
    machine.arrive(requests, f"{scratch.folder}/events", slices)
    return machine.run(spark, f"{scratch.folder}/events", f"{scratch.folder}/out", f"{scratch.folder}/state")


@native("y_03_job_state_machine", "job_requests", sql=_FOLD)
def y_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request and report with what the job machine makes of it."""
    return job_stream(spark, sf_dir)


@operator("y_05_stage_order", "job_events")
def y_05(d: Dialect) -> str:
    """The stage that an event's percent lies in."""
    rows = ", ".join(f"('{s}', {p}, {n})" for (s, p), n in zip(STAGES, [*(p for _, p in STAGES[1:]), 101], strict=True))
    return f"SELECT e.job_id, e.turn, s.stage FROM {{job_events}} e LEFT JOIN (SELECT * FROM (VALUES {rows}) AS v(stage, low, high)) s ON e.percent >= s.low AND e.percent < s.high"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "job_events")
    return e.select("job_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"), "kind", "percent")


@native("y_01_progress_publish", "job_events", sql="SELECT job_id, count(*) AS events, max(percent) AS percent FROM {job_events} GROUP BY job_id")
def y_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as published, read back from where streams read them."""
    folder = Scratch(spark, "progress").folder
    jobs.publish(_events(spark, sf_dir), folder)
    return spark.read.schema(jobs.EVENTS).json(folder).groupBy("job_id").agg(F.count("*").alias("events"), F.max("percent").alias("percent"))


@native("y_02_latest_state", "job_events", sql="SELECT job_id, max_by(kind, turn) AS state, max_by(percent, turn) AS percent FROM {job_events} GROUP BY job_id")
def y_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each job, by the aggregate that the stream runs."""
    return jobs.latest_state(_events(spark, sf_dir)).select("job_id", "state", "percent")


@native("y_04_cancelled", "job_requests", sql=f"SELECT repo, job, min(seq) AS stopped_by FROM ({_FOLD}) f WHERE outcome = 'STOPPED' GROUP BY repo, job")
def y_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that met their cancellation flag while it held, and the report that met it."""
    return job_stream(spark, sf_dir).where("outcome = 'STOPPED'").groupBy("repo", "job").agg(F.min("seq").alias("stopped_by"))


@native(
    "y_08_audit_stream",
    "turns",
    sql="WITH RECURSIVE o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {turns}), c AS (SELECT conv_id, k, sha256(turn || '|' || role || '|' || text || '|' || repeat('0', 64)) AS h FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, sha256(o.turn || '|' || o.role || '|' || o.text || '|' || c.h) FROM c JOIN o ON o.conv_id = c.conv_id AND o.k = c.k + 1) SELECT conv_id, count(*) AS events, max_by(h, k) AS head FROM c GROUP BY conv_id",
)
def y_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's length and the hash that the next event will point to, from the trail that a stream has appended in batches."""
    scratch = Scratch(spark, "trail")
    machine.arrive(view(spark, sf_dir, "turns").withColumn("at", F.timestamp_seconds("turn")), f"{scratch.folder}/turns", 3)
    made = trail.Trail(spark, f"{scratch.folder}/trail")
    made.follow(f"{scratch.folder}/turns", f"{scratch.folder}/state")
    return made.heads().select("conv_id", "events", "head")
