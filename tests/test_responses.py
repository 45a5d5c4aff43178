"""Validation of responses and affected boundary rules on hand-made rows."""

from girder.functions import scalars
from girder.operators import governance
from girder.plans.operator import REGISTRY

assert scalars.l_08_response and governance.c_12

COLUMNS = "response_id long, target_id string, finding_id string, target_path string, patch_path string, confidence double, unified_diff string, snippet string, line_start int, line_end int, cites string, enclosing string"
DIFF = "--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n"


def response(i, **given):
    row = {"target_id": "F1", "finding_id": "F1", "target_path": "src/a.py", "patch_path": "src/a.py", "confidence": 0.5, "unified_diff": DIFF, "snippet": "x = 1", "line_start": 3, "line_end": 3, "cites": "run load", "enclosing": "def run(): load()"}
    return (i, *{**row, **given}.values())


def test_responses(spark):
    token = "AKIA" + "A" * 16
    rows = {
        1: (response(1), (False, 0.5, "KEPT", "", "")),
        2: (response(2, finding_id="F9", confidence=7.0), (True, 1.0, "KEPT", "", "")),
        3: (response(3, finding_id=None, confidence=None), (False, 0.0, "KEPT", "", "")),
        4: (response(4, patch_path=" src\\a.py "), (False, 0.5, "KEPT", "", "")),
        5: (response(5, patch_path="src/b.py"), (False, 0.5, "OTHER_FILE", "", "")),
        6: (response(6, target_path="../a.py", patch_path="../a.py"), (False, 0.5, "TRAVERSAL", "FILE", "")),
        7: (response(7, target_path="/etc/a", patch_path="/etc/a"), (False, 0.5, "TRAVERSAL", "FILE", "")),
        8: (response(8, target_path="src/none.py", patch_path="src/none.py"), (False, 0.5, "NO_FILE", "FILE", "")),
        9: (response(9, unified_diff="+++ b/src/a.py"), (False, 0.5, "NO_HEADER", "", "")),
        10: (response(10, unified_diff=None), (False, 0.5, "NO_HEADER", "", "")),
        11: (response(11, snippet="x" * 100_000 + token), (False, 0.5, "SECRET", "", "")),
        12: (response(12, patch_path=None, confidence=-2.0, snippet=None), (False, 0.0, "NONE", "", "")),
        13: (response(13, line_start=0), (False, 0.5, "KEPT", "LINES", "")),
        14: (response(14, line_start=3, line_end=2), (False, 0.5, "KEPT", "LINES", "")),
        15: (response(15, line_end=None, cites="walk run"), (False, 0.5, "KEPT", "SYMBOLS", "walk")),
        16: (response(16, cites="walk walk", line_start=None), (False, 0.5, "KEPT", "LINES,SYMBOLS", "walk")),
        17: (response(17, cites=None, enclosing=None), (False, 0.5, "KEPT", "", "")),
        18: (response(18, cites="run", enclosing=""), (False, 0.5, "KEPT", "SYMBOLS", "run")),
        19: (response(19, target_path=None), (False, 0.5, "OTHER_FILE", "FILE", "")),
    }
    files = spark.createDataFrame([(1, "src/a.py"), (2, "src/a.py"), (3, None)], "pos long, path string")
    df = spark.createDataFrame([r for r, _ in rows.values()], COLUMNS)
    got = {r["response_id"]: (r["corrected"], r["confidence"], r["patch"], r["problems"], r["unknown_symbols"]) for r in REGISTRY["l_08_response_validation"](spark, responses=df, files=files).collect()}
    assert got == {i: want for i, (_, want) in rows.items()}
    assert REGISTRY["l_08_response_validation"](spark, responses=df.limit(0), files=files).count() == 0


def test_affected_boundary_rules(spark):
    changes = spark.createDataFrame([(1, "SQL_EXECUTE"), (2, "DOM_INJECTION"), (3, "FILE_PATH"), (4, None), (1, "SQL_EXECUTE"), (5, "CODE_EVAL")], "change_id long, category string")
    findings = spark.createDataFrame([("SEC-PY-011",), ("SEC-PY-011",), ("SEC-JS-009",), (None,)], "rule_id string")
    got = REGISTRY["c_12_affected_boundary_rules"](spark, sanitizer_changes=changes, audit_findings=findings)
    assert sorted(map(tuple, got.collect())) == [(1, "SQL_EXECUTE", "SEC-PY-011", 2), (1, "SQL_EXECUTE", "SEC-PY-011", 2), (2, "DOM_INJECTION", "SEC-JS-009", 1), (5, "CODE_EVAL", "SEC-JS-010", 0)]
