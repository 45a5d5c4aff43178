"""Project files, caches, resolution and composition across files on hand-made rows."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from girder.operators import graph, project as operators, source_code
from girder.operators.governance import CONTROLS, POLICIES
from girder.plans.operator import REGISTRY
from girder.plans import scratch
from girder.sources import project, sinks

CONFIG = "version: 1\nanalysis:\n  max_call_depth: 7   # deeper\n  disabled_rules: [ARC-002, SEC-JS-006]\n  fail_on: high\npaths:\n  exclude:\n    - node_modules\n    - 'a # b'\n"


def test_yaml():
    assert project.load_yaml(CONFIG)["analysis"] == {"max_call_depth": 7, "disabled_rules": ["ARC-002", "SEC-JS-006"], "fail_on": "high"}
    assert project.load_yaml(CONFIG)["paths"]["exclude"] == ["node_modules", "a # b"]
    assert project.load_yaml("a:\n- b: 1\n  c: x\n- d\ne: null\nf: 'it''s'\ng: -1.5\n") == {"a": [{"b": 1, "c": "x"}, "d"], "e": None, "f": "it's", "g": -1.5}
    assert project.load_yaml('{"a": [1, true]}') == {"a": [1, True]}
    for bad in ("a: 1\n   b: 2\n", "a: 1\na: 2\n", "just text\n"):
        with pytest.raises(project.Invalid):
            project.load_yaml(bad)


def test_configuration_precedence_and_limits():
    c = project.configuration(CONFIG, {"max_call_depth": 3, "top": None})
    assert c["max_call_depth"] == 3 and c["fail_on"] == "HIGH" and c["exclude"] == ("node_modules", "a # b") and c["top"] == 25
    assert project.configuration(CONFIG)["max_call_depth"] == 7 and project.configuration()["max_call_depth"] == 5
    for bad in ("analysis:\n  max_call_depth: 0\n", "analysis:\n  max_k: 3\n", "analysis:\n  fail_on: loud\n", "analysis:\n  nothing: 1\n", "other:\n  a: 1\n", "analysis:\n  interprocedural: 1\n", "- a\n"):
        with pytest.raises(project.Invalid):
            project.configuration(bad)
    a, b = project.scoped_digests(project.configuration()), project.scoped_digests(project.configuration(CONFIG))
    assert {k for k in a if a[k] != b[k]} == {"callgraph", "rules", "gate", "paths"}


def test_workspace_and_packs(spark):
    text = "workspace_id: w\nname: W\nrepositories:\n  - id: a\n    path: ./a\n  - id: b\n    criticality: high\n    depends_on: [a]\n"
    w = project.workspace(text)
    assert [m.id for m in w.repositories] == ["a", "b"] and w.repositories[1].depends_on == ("a",) and w.rows(spark).count() == 2
    for bad in ("name: W\n", text + "  - id: a\n", text + "  - id: c\n    depends_on: [z]\n", text + "  - path: x\n"):
        with pytest.raises(project.Invalid):
            project.workspace(bad)
    assert project.pack_order({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}, "d") == ["a", "b", "c", "d"]
    for parents in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}):
        with pytest.raises(project.Invalid):
            project.pack_order(parents, "a")


def test_guard_and_git(tmp_path):
    assert project.guarded(str(tmp_path)) == tmp_path.resolve()
    (tmp_path / "f").write_text("x")
    for bad in ("", "/", "/etc", "/usr/lib", str(tmp_path / "f")):
        with pytest.raises(project.Invalid):
            project.guarded(bad)
    with pytest.raises(FileNotFoundError):
        project.guarded(str(tmp_path / "no"))
    assert project.git_metadata(str(tmp_path)) == {"commit": None, "branch": None, "dirty": None}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("-c", "user.email=a@b", "-c", "user.name=n", "add", "f")
    run("-c", "user.email=a@b", "-c", "user.name=n", "commit", "-q", "-m", "x")
    said = project.git_metadata(str(tmp_path))
    assert said["branch"] == "main" and len(said["commit"]) == 40 and said["dirty"] is False
    (tmp_path / "f").write_text("y")
    assert project.git_metadata(str(tmp_path))["dirty"] is True


def test_baseline(spark, tmp_path):
    one = {"id": "F1", "rule_id": "R", "severity": "HIGH", "category": "SECURITY", "code_snippet": None, "location": {"file_path": "a.py", "line_start": 3}}
    (tmp_path / "b.json").write_text(json.dumps({"findings": [one, one | {"id": "F2"}], "other": 1}, indent=1))
    rows = project.baseline(spark, str(tmp_path / "b.json")).collect()
    assert [(r["input_pos"], r["id"], r["line"], r["col"], r["snippet"]) for r in rows] == [(0, "F1", 3, 0, ""), (1, "F2", 3, 0, "")]


def test_eviction_and_packing(spark):
    old = spark.createDataFrame([(f"k{i}", "L", i * 1800, 10) for i in range(20)], "key string, layer string, at long, size long").withColumn("written", F.timestamp_seconds("at"))
    assert {r["key"] for r in operators.evicted(old, 75, 100).collect()} == {f"k{i}" for i in range(13)}
    assert {r["key"] for r in operators.evicted(old, 10_000, 3).collect()} == {f"k{i}" for i in range(17)} and operators.evicted(old, 200, 20).count() == 0
    assert operators.unpacked(operators.packed("é"), __import__("hashlib").sha256("é".encode()).hexdigest()) == "é" and operators.unpacked(b"x", "y") is None


FILES = {
    "src/app/main.py": "import os\nfrom app.db import save, load\nfrom . import util\nimport app.util as u\nfrom .gone import x\nimport flask\nfrom json import *\ndef main(request):\n    q = request.args['q']\n    save(q)\n    u.run(q)\n    r = util.read()\n    os.system(r)\n    alone(q)\n",
    "src/app/db.py": "def save(a, cursor=None):\n    b = a\n    cursor.execute(b)\ndef load(a):\n    return int(a)\ndef unused(a):\n    return a\ndef _private():\n    pass\n",
    "src/app/util.py": "def run(a):\n    if not a.isdigit():\n        return deep(a)\n    os.system(a)\ndef deep(a):\n    os.system(a)\ndef read():\n    return request.form['z']\nclass T:\n    def go(self):\n        return self.help()\n    def help(self):\n        return 1\n",
    "src/app/one.py": "def alone(a):\n    return a\n",
    "src/app/__init__.py": "",
    "web/a.ts": "import b, { c } from './b'\nimport x from '@lib/x'\nimport fs from 'fs'\nimport r from 'react'\nimport y from './no'\nexport function f(q) { c(q); b(q) }\n",
    "web/b/index.tsx": "export function c(q) { el.innerHTML = q }\nexport default function b(q) { return q }\n",
    "lib/x.js": "export const x = 1\n",
}


@pytest.fixture(scope="module")
def code(spark):
    kind = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript"}
    files = spark.createDataFrame([(p, kind[p.rsplit(".", 1)[1]], t) for p, t in FILES.items()] + [("src/null.py", "python", None), ("a.rb", "ruby", "x")], "path string, language string, content string")
    return files, source_code.facts(files).cache()


def test_imports_resolve_in_order(code):
    files, f = code
    got = {(r["path"], r["name"]): (r["category"], r["resolved"]) for r in source_code.python_imports(f, files).collect()}
    main = {k[1]: v for k, v in got.items() if k[0] == "src/app/main.py"}
    assert main == {"os": ("STDLIB", None), "app.db": ("LOCAL", "src/app/db.py"), ".": ("LOCAL", "src/app/__init__.py"), "app.util": ("LOCAL", "src/app/util.py"), ".gone": ("UNRESOLVED", None), "flask": ("EXTERNAL", None), "json": ("STDLIB", None)}
    js = {r["name"]: (r["category"], r["resolved"]) for r in source_code.javascript_imports(f, files, (("@lib/", "lib/"),)).collect()}
    assert js == {"./b": ("LOCAL", "web/b/index.tsx"), "@lib/x": ("LOCAL", "lib/x.js"), "fs": ("STDLIB", None), "react": ("EXTERNAL", None), "./no": ("UNRESOLVED", None)}


def test_calls_taint_and_contracts_across_files(spark, code):
    files, f = code
    imports = source_code.all_imports(f, files)
    calls = source_code.resolved_calls(f, imports).cache()
    tiers = {(r["path"], r["callee"]): (r["tier"], r["target_path"]) for r in calls.collect()}
    assert tiers["src/app/main.py", "save"] == ("IMPORTED", "src/app/db.py") and tiers["src/app/main.py", "u.run"] == ("MODULE", "src/app/util.py") and tiers["src/app/main.py", "alone"] == ("UNIQUE", "src/app/one.py")
    assert tiers["src/app/util.py", "deep"] == ("SAME_FILE", "src/app/util.py") and tiers["src/app/util.py", "self.help"] == ("METHOD", "src/app/util.py") and tiers["src/app/main.py", "os.system"] == ("EXTERNAL_MODULE", None)
    found = {(r["source_function"], r["sink_path"], r["sink_function"], r["category"], r["depth"]) for r in source_code.interprocedural(spark, source_code.flows(files), calls).collect()}
    assert found == {("main", "src/app/db.py", "save", "SQL", 1), ("main", "src/app/util.py", "deep", "COMMAND", 2)}
    states = {(r["function"], r["callee"]): r["state"] for r in source_code.preconditions(source_code.flows(files), calls).collect()}
    assert states == {("main", "save"): "VIOLATED", ("run", "deep"): "UNKNOWN", ("f", "c"): "UNKNOWN"}


def test_calls_linked_once_a_file_and_name(spark, code):
    """One row a file and name, whatever the number of calls, the same as the calls one by one."""
    more = [("a/x.py", "python", "def run(v):\n    return v\n"), ("a/y.py", "python", "def run(v):\n    return v\n"), ("a/z.py", "python", "from a.y import run\nfrom a.x import run\nfrom a.y import run as go\nclass C:\n    def help(self):\n        pass\n    def f(self, v):\n        self.help()\n        run(v)\n        run(v)\n        go(v)\nclass D:\n    def help(self):\n        pass\n    def f(self, v):\n        self.help()\n        nothing(v)\n")]
    files = code[0].union(spark.createDataFrame(more, "path string, language string, content string"))
    f, links = source_code.together(files, "linked-test", facts=(source_code.FACTS, source_code._named), links=(source_code.LINKS, source_code._linking))
    got = [tuple(r) for r in source_code.linked_calls(links, f.where("kind = 'function'"), source_code.all_imports(f, files)).collect()]
    every = source_code.facts(files)
    each = source_code.resolved_calls(every, source_code.all_imports(every, files)).where("target is not null")
    assert sorted(got) == sorted(tuple(r) for r in each.select("path", "callee", "target_path", "target").distinct().collect())
    assert [r for r in got if r[:2] == ("a/z.py", "run")] == [("a/z.py", "run", "a/x.py", "run")] and len([r for r in got if r[:2] == ("a/z.py", "self.help")]) == 2


def test_results_that_carry_a_source(spark):
    files = spark.createDataFrame([("a.py", "python", "from b import read\ndef f(x):\n    y = read()\n    os.system(y)\n    g(y)\ndef g(z):\n    cursor.execute(z)\n"), ("b.py", "python", "def read():\n    return inner()\ndef inner():\n    return request.args['a']\n")], "path string, language string, content string")
    f = source_code.facts(files)
    calls = source_code.resolved_calls(f, source_code.all_imports(f, files))
    got = {(r["source_function"], r["sink_function"], r["category"]) for r in source_code.interprocedural(spark, source_code.flows(files), calls).collect()}
    assert got == {("read", "f", "COMMAND"), ("read", "g", "SQL")}


def test_orphans(code):
    files, f = code
    got = {(r["path"], r["name"]) for r in source_code.orphan_exports(f, source_code.all_imports(f, files)).collect()}
    assert ("src/app/db.py", "unused") in got and ("src/app/db.py", "save") not in got and ("src/app/db.py", "_private") not in got
    assert not {p for p, _ in got} & {"src/app/main.py", "src/app/util.py", "web/b/index.tsx"}  # where programs begin; imported whole; by default


def test_strong_components_and_betweenness(spark):
    import random

    r = random.Random(4)
    for _ in range(4):
        n = 14
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(10, 30))}
        reach = {(a, b) for a, b in pairs}
        for k in range(n):
            reach |= {(a, b) for a in range(n) for b in range(n) if (a, k) in reach and (k, b) in reach}
        want = {i: min([i, *(j for j in range(n) if (i, j) in reach and (j, i) in reach)]) for i in range(n)}
        got = graph.strong_components(spark.createDataFrame(sorted(pairs), "a long, b long"), spark.range(n).select("id"))
        assert {x["id"]: x["scc"] for x in got.collect()} == want
    star = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 4), (3, 4)], "a long, b long")
    got = {x["id"]: x["betweenness"] for x in graph.betweenness(star, spark.range(5).select("id")).collect()}
    assert got == {0: 0.0, 1: 0.25, 2: round(1.0 / 12, 4), 3: round(1.0 / 12, 4), 4: 0.0}


def test_controls_of_the_catalog():
    assert len(CONTROLS) == 17 and {f: sum(c[1] == f for c in CONTROLS) for f in ("PCI", "HIPAA", "SOC2", "NIST")} == {"PCI": 5, "HIPAA": 4, "SOC2": 4, "NIST": 4} and len(POLICIES) == 5


AUDIT = "input_pos long, id string, repo_id string, file_path string, line int, severity string, day string, rule_id string, sink string, sanitizer string, has_auth boolean, has_authz boolean, property string, suppression string, expires string, accepted boolean, value_type string, value_format string"


def audit(pos, rule, sink="", sanitizer="", auth=True, authz=True, prop="", suppression=None, expires=None, accepted=False):
    return (pos, f"F{pos}", "r", "a.py", 1, "HIGH", "2024-02-01", rule, sink, sanitizer, auth, authz, prop, suppression, expires, accepted, "", "")


def test_policies_and_controls(spark):
    rows = [
        audit(1, "SEC-PY-009", "SQL_EXECUTE"), audit(2, "SEC-PY-009", "SQL_EXECUTE", "int"), audit(3, "SEC-PY-009", "SQL_EXECUTE", prop="SQL_SAFE"), audit(4, "SEC-PY-009", "DOM_INJECTION"), audit(5, "SEC-PY-008", auth=False),
        audit(6, "SEC-PY-008", authz=False), audit(7, "SEC-PY-008"), audit(8, "SEC-PY-002", suppression="SUPPRESSED"), audit(9, "SEC-PY-006", suppression="SUPPRESSED", expires="2024-01-01"), audit(10, "SEC-JS-006", accepted=True),
    ]
    f = spark.createDataFrame(rows, AUDIT)
    states = {r["id"]: (r["policy_id"], r["state"], r["obligation"]) for r in REGISTRY["c_14_policy_evaluation"](spark, audit_findings=f).collect()}
    assert states == {"F1": ("POL-SQL-01", "PROVEN_VIOLATION", "SQL_SAFE"), "F2": ("POL-SQL-01", "PROVEN_SAFE", ""), "F3": ("POL-SQL-01", "PROVEN_SAFE", ""), "F5": ("POL-AUTHZ-01", "PROVEN_VIOLATION", "AUTHENTICATION"), "F6": ("POL-AUTHZ-01", "PROVEN_VIOLATION", "AUTHORIZATION"), "F7": ("POL-AUTHZ-01", "PROVEN_SAFE", "")}
    assert {r["id"] for r in REGISTRY["c_15_policy_filter"](spark, audit_findings=f).collect()} == {"F1", "F4", "F5", "F6", "F8", "F9", "F10"}
    held = {r["control_id"]: (r["active"], r["suppressed"], r["score"], r["status"]) for r in REGISTRY["a_13_control_evaluation"](spark, audit_findings=f).collect()}
    assert held["HIPAA-164.312(c)(1)"] == (4, 0, 0.2, "VIOLATED") and held["HIPAA-164.312(b)"] == (0, 1, 0.8, "PARTIAL") and held["PCI-6.3.2"] == (0, 0, 1.0, "COMPLIANT") and held["NIST-SC-13"] == (1, 0, 0.8, "VIOLATED")


def test_run_tables_and_sheets(spark, tmp_path):
    from tests.test_engine import FINDINGS, finding

    f = spark.createDataFrame([finding(1, snippet='password = "hunter2"'), finding(2, path="=x/y", severity="LOW"), finding(3, rule="Q")], FINDINGS)
    out = sinks.save_run(f, str(tmp_path / "run"))
    assert set(out) == {"snapshots", "findings", "deductions", "components", "edges"} and "hunter2" not in str(out["findings"].collect())
    assert out["snapshots"].first()["total_findings"] == 3 and {r["sheet"] for r in sinks.sheet_rows(f).collect()} == set(sinks.SHEETS)
    assert any(r["cells"].split("|")[2].startswith("'=x") for r in sinks.sheet_rows(f).where("sheet = 'Findings'").collect())
    said = operators.terminal(f, 2)
    assert said.startswith("3 findings: 2 HIGH, 1 LOW") and said.endswith("and 1 more\n") and "\033[" in operators.terminal(f, 2, colour=True)


def test_scratch_is_cleared(spark):
    s = scratch.Scratch(spark, "cleared")
    assert s.save(spark.range(3), "t").count() == 3
    kept, scratch.BEGUN[:] = scratch.BEGUN[:], [s.folder]
    assert scratch.clear(spark) == 1
    scratch.BEGUN[:] = [x for x in kept if x != s.folder]
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.folder}/t")
