"""Operators on hand-made rows, every query with SQL against DuckDB, extraction, sinks, streams, and independence of the llm subpackage."""

import os
import random
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from girder import queries as engine
from girder.operators import code, graph
from girder.plans.operator import REGISTRY
from girder.plans.views import VIEWS
from girder.sources import extract, sinks
from girder.streaming import jobs

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
FINDINGS = "input_pos long, id string, rule_id string, file_path string, repo_id string, line int, col int, severity string, confidence string, category string, evidence_type string, snippet string, value double, user_id long, day string"


def finding(pos, rule="R", severity="HIGH", category="SECURITY", line=1, path="a.py", snippet="s", repo="r", day="2024-01-01"):
    return (pos, f"F{pos}", rule, path, repo, line, 0, severity, "HIGH", category, "DETERMINISTIC", snippet, 1.0, 1, day)


def run(spark, op, **frames):
    return [tuple(r) for r in REGISTRY[op](spark, **frames).collect()]


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, int | str | bool) else float(v) if hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(engine.oracle_sql()) - SLOW))
def test_oracle(spark, duck, name):
    got = engine.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    rel = duck.sql(engine.oracle_sql()[name])
    want = rel.fetchall()
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in at]) for r in want)
    assert rows == want


def test_health_cap_and_grades(spark):
    rows = [finding(i, severity="CRITICAL") for i in range(4)] + [finding(9, rule="Q", severity="LOW", category="ARCHITECTURE")]
    f = spark.createDataFrame(rows, FINDINGS)
    assert sorted(run(spark, "a_04_health_subscore", findings=f)) == [("r", "ARCHITECTURE", 98.0, 2), ("r", "SECURITY", 55.0, 45)]
    assert run(spark, "p_17_letter_grade", findings=f) == [("r", 74.35, "C")]
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), FINDINGS)
    assert sorted(run(spark, "a_04_health_subscore", findings=shuffled)) == sorted(run(spark, "a_04_health_subscore", findings=f))


def test_dedup_keeps_first(spark):
    f = spark.createDataFrame([finding(2), finding(1), finding(3, line=2)], FINDINGS)
    assert sorted(r[0] for r in run(spark, "w_07_dedup_keep_first", findings=f)) == [1, 3]


def test_baseline_transitions(spark):
    cols = ("input_pos", "id", "rule_id", "file_path", "line", "col", "severity", "category", "snippet")
    cur = spark.createDataFrame([finding(1), finding(2, line=25, snippet="moved"), finding(3, rule="N")], FINDINGS).select(*cols)
    base = spark.createDataFrame([finding(11), finding(12, line=20, snippet="moved"), finding(14, rule="G")], FINDINGS).select(*cols)
    got = {(r[0], r[1]): r[3] for r in run(spark, "j_01_baseline_diff", current_findings=cur, baseline_findings=base)}
    assert got == {(1, 11): "UNCHANGED", (2, 12): "MODIFIED", (3, -1): "NEW", (-1, 14): "RESOLVED"}


def test_velocity_conserves_live_keys(spark):
    r = random.Random(3)
    keys = [(s, f"d{s}", f"k{k}") for s in range(1, 9) for k in range(20) if r.random() < 0.5]
    k = spark.createDataFrame(keys, "seq int, snapshot string, key string")
    s = spark.createDataFrame([(i, f"d{i}") for i in range(1, 9)], "seq int, snapshot string")
    rows = sorted(run(spark, "w_01_defect_velocity", snapshot_keys=k, snapshots=s))
    live = 0
    for seq, new, gone, net in rows:
        assert net == new - gone
        live += net
        assert live == sum(x[0] == seq for x in keys)


def test_closures_components_waves(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (6, 6)], "a long, b long")
    nodes = spark.range(1, 8).select("id")
    assert {tuple(r) for r in graph.components(e, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)}
    assert {tuple(r) for r in graph.strong_components(e, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)}
    assert {r["cycle"] for r in graph.simple_cycles(e).collect()} == {"1>2>3"}
    dag = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "id long, needs long")
    assert {tuple(r) for r in graph.waves(dag, spark.range(1, 5)).collect()} == {(1, 0), (2, 1), (3, 2), (4, 0)}
    with pytest.raises(ValueError):
        graph.waves(e.toDF("id", "needs"), spark.range(1, 4))


def test_calls_of_every_order(spark):
    items = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (40, 1, 30), (40, 2, 10)], "l_orderkey long, l_linenumber int, l_partkey long")
    got = spark.sql(VIEWS["calls"].sql, lineitem=items).select("caller", "callee").collect()
    assert {tuple(r) for r in got} == {(10, 20), (30, 10)}


def test_long_cycles(spark):
    ring = spark.createDataFrame([(i, i % 9 + 1) for i in range(1, 10)], "a long, b long")
    assert [tuple(r) for r in graph.simple_cycles(ring, name="ring").collect()] == [("1>2>3>4>5>6>7>8>9", 9)]
    assert graph.simple_cycles(ring.where("false"), name="none").count() == 0


def test_every_secret_of_a_text(spark):
    t = spark.createDataFrame([(1, 'token = "abc" and password = "0123456789abcdef" or secret="fedcba9876543210"'), (2, None), (3, "none")], "doc_id long, text string")
    assert sorted(run(spark, "sec_py_001_secrets", texts=t)) == [(1, "012...ef", "HIGH"), (1, "fed...10", "HIGH")]
    assert sorted(run(spark, "p_14_redact_secret", texts=t)) == [(1, "***"), (1, "012...ef"), (1, "fed...10")]
    assert sorted(run(spark, "p_13_secret_predicate", texts=t)) == [(1, False), (1, True), (1, True)]
    assert [r[1] for r in sorted(run(spark, "p_12_shannon_entropy", texts=t))] == [1.585, 4.0, 4.0]


def test_whole_cells_are_sanitised(spark):
    texts = ["=" + "x" * 99, "a\x01b\x0b" + "y" * 99, "\tz", "\r1", "\x02-1", "a\n퟿\U0001f600b", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = ["'=" + "x" * 99, "ab" + "y" * 99, "'\tz", "'\r1", "'-1", "a\n퟿b", "", ""]
    assert sorted(run(spark, "p_16_spreadsheet_sanitise", texts=t)) == list(enumerate(want))


def test_diff_order_is_whole(spark):
    cols = ("input_pos", "id", "rule_id", "file_path", "line", "col", "severity", "category", "snippet")
    cur = spark.createDataFrame([finding(i, rule=f"N{i}") for i in range(110)] + [finding(200, line=5, snippet="m"), finding(201)], FINDINGS).select(*cols)
    base = spark.createDataFrame([finding(300, line=4, snippet="m"), finding(301), finding(302, rule="G")], FINDINGS).select(*cols)
    got = run(spark, "o_03_diff_order", current_findings=cur, baseline_findings=base)
    assert got == [*((i, -1, "NEW") for i in range(110)), (200, 300, "MODIFIED"), (201, 301, "UNCHANGED"), (-1, 302, "RESOLVED")]


def test_rule_activation(spark):
    f = spark.createDataFrame([finding(i, rule=r, repo=p) for i, (p, r) in enumerate([("a", "R1"), ("b", "R2"), ("c", "R3")])], FINDINGS)
    s = spark.createDataFrame([("a", "R1", "ENABLE"), ("a", "R2", "ENABLE"), ("a", "R2", "DISABLE"), ("b", "R3", "DISABLE"), ("b", "GONE", "ENABLE")], "repo_id string, rule_id string, action string")
    got = run(spark, "f_03_rule_activation", findings=f, rule_settings=s)
    assert sorted(x[:2] for x in got if x[2]) == [("a", "R1"), ("b", "R1"), ("b", "R2"), ("c", "R1"), ("c", "R2"), ("c", "R3")]
    assert [x for x in got if x[3]] == [("b", "GONE", False, True)] and len(got) == 10


def test_frameworks_of_all_files(spark):
    f = spark.createDataFrame([(59, "src/a.py", "python"), (60, "src/b.py", "python"), (9000, "c.py", "python")], "pos long, path string, language string")
    assert sorted(run(spark, "s_09_framework_detection", files=f)) == [("django", 2.0, 0.8), ("flask", 1.0, 0.7)]


def test_betweenness_of_a_chain(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(e, spark.range(1, 4)).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.0}


def test_python_facts_and_rules(spark):
    rows = [(f"f{i}.py", t) for i, t in enumerate(code.TEMPLATES)]
    files = spark.createDataFrame([*rows, ("empty.py", ""), ("null.py", None)], "path string, content string")
    facts = extract.facts(files)
    assert facts.where("kind = 'error'").select("path").collect()[0][0] == "f4.py"
    got = {(r["rule_id"], r["path"]) for r in extract.security_findings(facts).collect()}
    assert {("SEC-PY-002", "f2.py"), ("SEC-PY-003", "f0.py"), ("SEC-PY-004", "f3.py"), ("SEC-PY-006", "f2.py"), ("SEC-PY-007", "f5.py"), ("SEC-PY-008", "f3.py")} <= got
    assert facts.where("kind = 'call' and name = 'hashlib.md5'").count() == 2 and sum(r == "SEC-PY-006" for r, _ in got) == 1


@pytest.mark.parametrize(
    ("body", "hits"),
    [
        ("q = request.args['x']\n  c.execute(q)", ["TAINTED"]),
        ("q = int(request.args['x'])\n  c.execute(q)", []),
        ("q = 'a'\n  if q:\n    q = request.form['x']\n    return\n  c.execute(q)", []),
        ("q = 'a'\n  if q:\n    q = request.form['x']\n  c.execute('s' + q)", ["TAINTED"]),
        ("q = request.form['x']\n  q = 'safe'\n  c.execute(q)", []),
        ("q = request.form['x']\n  c.execute('select %s', q)", []),
        ("q = ''\n  for i in x:\n    c.execute(q)\n    q = q + request.args['x']", ["TAINTED"]),
    ],
)
def test_taint_fold(body, hits):
    assert [h[4] for h in extract.taint_paths(f"def f(c, request, x):\n  {body}\n")] == hits


def test_discover(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0")
    (tmp_path / "src/c.py").write_bytes(b"a\0b")
    (tmp_path / "src/min.js").write_text("x" * 9000)
    (tmp_path / "node_modules/d.js").write_text("y")
    got = [(r["path"].rsplit("/", 1)[1], r["line_count"]) for r in extract.discover(spark, str(tmp_path)).collect()]
    assert got == [("a.py", 3)]


def test_canonical_json():
    assert code.canonical_json({"b": 1.0, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([finding(1, snippet='password = "hunter2"'), finding(2, path="=x", severity="LOW")], FINDINGS)
    assert "| HIGH | R |" in sinks.markdown(f)
    sinks.save_snapshot(f, str(tmp_path / "snap"))
    assert "hunter2" not in str(spark.read.parquet(str(tmp_path / "snap")).collect())
    sinks.save_audit_log(f, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    assert sinks.sarif_rows(f).count() == sinks.gitlab_rows(f).count() == sinks.cyclonedx_rows(f).count() == 2


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(1, "2024-01-01 00:00:00", "QUEUED", 0), (1, "2024-01-01 00:01:00", "RUNNING", 10), (1, "2024-01-01 00:02:00", "COMPLETED", 100), (1, "2024-01-01 00:03:00", "RUNNING", 5), (2, "2024-01-01 00:00:00", "RUNNING", 1)]
    events = spark.createDataFrame(rows, "job_id long, ts string, kind string, percent int").withColumn("ts", F.to_timestamp("ts"))
    jobs.publish(events, folder)
    stream = jobs.read_events(spark, folder)
    for name, df, mode in (("states", jobs.job_states(stream), "update"), ("chains", jobs.audit_chains(stream), "append"), ("latest", jobs.latest_state(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        # a query with a timer never runs dry, so it is stopped once its first batch is there
        end = time.time() + 90
        while not spark.table(name).take(1) and time.time() < end:
            time.sleep(0.5)
        q.stop()
    assert {tuple(r) for r in spark.table("states").collect()} == {(1, "COMPLETED", 100, 3, 1), (2, None, 0, 0, 1)}
    chain = sorted(spark.table("chains").where("job_id = 1").collect(), key=lambda r: r["ts"])
    assert all(b["prev_hash"] == a["event_hash"] for a, b in zip(chain, chain[1:], strict=False))
    assert {(r["job_id"], r["state"]) for r in spark.table("latest").collect()} == {(1, "RUNNING"), (2, "RUNNING")}


def test_entry_stands_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "girder", tmp_path / "girder", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[-2]) > 150
