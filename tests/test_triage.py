"""Features of findings, verdicts and the classifier against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.operators import triage

FIELDS = "finding_id string, rule_id string, language string, severity string, confidence string, category string, file_path string, evidence_type string, source_boundary string, sink_category string, sanitized boolean, taint_depth int, call_depth int, path_certainty double, component long"


def finding(i, **given):
    row = {"finding_id": i, "rule_id": "R", "language": "Python", "severity": "high", "confidence": "low", "category": "security", "file_path": "a/b.py", "evidence_type": "heuristic", "source_boundary": "NETWORK", "sink_category": "SQL", "sanitized": True, "taint_depth": 3, "call_depth": 2, "path_certainty": 0.5, "component": 1}
    return tuple({**row, **given}.values())


def test_features(spark):
    empty = {k: None for k in FIELDS.replace(",", "").split()[2::2]}
    rows = [finding("a"), finding("b", **empty), finding("c", path_certainty=7.0, component=2, file_path="\\tests\\x\\\\.\\test_y.py/", severity="odd", confidence="odd"), finding("d", path_certainty=-1.0, file_path="tests/a.py", category="ARCHITECTURE"), finding("a")]
    df = spark.createDataFrame(rows, FIELDS).withColumns({"fp_rate": F.lit(9), "instability": F.lit("x")})
    components = spark.createDataFrame([(1, "DOMAIN", 0.123456)], "component long, layer string, instability double")
    history = spark.createDataFrame([("R", 0.66666)], "rule_id string, fp_rate double")
    held = spark.createDataFrame([("a",), ("a",)], "finding_id string")
    got = {r["finding_id"]: r.asDict() for r in triage.features(df, components, history, held).collect()}
    assert triage.features(df, components, history, held).count() == 5 and set(got["a"]) == {"finding_id", *triage.CATEGORICAL, *triage.NUMERIC}
    assert got["a"] == {"finding_id": "a", "rule_id": "R", "language": "python", "source_boundary": "NETWORK", "sink_category": "SQL", "layer": "DOMAIN", "evidence_type": "HEURISTIC", "severity_rank": 3, "confidence_rank": 0, "category_is_security": 1, "sanitizer_detected": 1, "taint_depth": 3, "call_depth": 2, "path_certainty": 0.5, "instability": 0.1235, "is_test_file": 0, "historical_rule_fp_rate": 0.6667, "has_prior_suppression": 1, "file_depth": 2}
    assert got["b"] == {"finding_id": "b", "rule_id": "UNKNOWN", "language": "plaintext", "source_boundary": "NONE", "sink_category": "NONE", "layer": "UNKNOWN", "evidence_type": "DETERMINISTIC", "severity_rank": 2, "confidence_rank": 1, "category_is_security": 1, "sanitizer_detected": 0, "taint_depth": 0, "call_depth": 0, "path_certainty": 1.0, "instability": 0.5, "is_test_file": 0, "historical_rule_fp_rate": 0.0, "has_prior_suppression": 0, "file_depth": 0}
    c = got["c"]
    assert (c["path_certainty"], c["severity_rank"], c["confidence_rank"], c["is_test_file"], c["file_depth"], c["layer"], c["has_prior_suppression"]) == (1.0, 2, 1, 1, 3, "UNKNOWN", 0)
    # the marks of folders have slashes on both sides, and what leads a path is taken off first
    assert (got["d"]["path_certainty"], got["d"]["is_test_file"], got["d"]["category_is_security"]) == (0.0, 0, 0)
    alone = triage.features(spark.createDataFrame([("z",)], "finding_id string")).first().asDict()
    assert alone["rule_id"] == "UNKNOWN" and alone["instability"] == 0.5 and alone["historical_rule_fp_rate"] == 0.0
    assert triage.features(df.limit(0), components, history, held).count() == 0


def test_verdicts(spark):
    featured = triage.features(spark.createDataFrame([finding("a"), finding("b")], FIELDS))
    reviews = spark.createDataFrame([(1, "a", " false_positive "), (2, "a", "Accepted_Risk"), (3, "x", "TRUE_POSITIVE"), (4, "a", "maybe"), (5, "x", None), (6, None, "suspect_heuristic"), (7, "b", ""), (1, "a", " false_positive ")], "review_id long, finding_id string, label string")
    got = sorted((r["review_id"], r["label"], r["status"], r["features"] is not None) for r in triage.captured(reviews, featured).collect())
    want = [(1, "FALSE_POSITIVE", "STORED", True)] * 2 + [(2, "ACCEPTED_RISK", "STORED", True), (3, "TRUE_POSITIVE", "UNKNOWN_FINDING", False), (4, "MAYBE", "UNKNOWN_LABEL", False), (5, None, "UNKNOWN_LABEL", False), (6, "SUSPECT_HEURISTIC", "UNKNOWN_FINDING", False), (7, "", "UNKNOWN_LABEL", False)]
    assert got == want


def plain(samples, labels, ask):
    """Newton's method on the same loss: categories one-hot, unknown ones all zero, intercept free."""
    values = [sorted({s[c] for s in samples}) for c in triage.CATEGORICAL]

    def vector(s):
        hot = [float(s[c] == v) for c, vs in zip(triage.CATEGORICAL, values, strict=True) for v in vs]
        return [*hot, *[float(s[c]) for c in triage.NUMERIC], 1.0]

    x, y = np.array([vector(s) for s in samples]), np.array(labels, float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty, b = np.diag([1.0] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + penalty, x.T @ (w * (p - y)) + penalty @ b)
        b -= step
    assert np.abs(step).max() < 1e-9
    return 1 / (1 + np.exp(-np.array([vector(s) for s in ask]) @ b))


def records(spark, n, positives, seed=1):
    r = random.Random(seed)
    rows = [finding(f"f{i}", rule_id=f"R{r.randrange(4)}", language=r.choice(["python", "go"]), sink_category=r.choice(["SQL", "DOM", "NONE"]), severity=r.choice(list(triage.SEVERITIES)), sanitized=r.random() < (0.8 if i < positives else 0.3), taint_depth=r.randrange(9), call_depth=r.randrange(5), path_certainty=r.random(), file_path="/".join("x" * r.randrange(1, 6))) for i in range(n)]
    featured = triage.features(spark.createDataFrame(rows, FIELDS))
    reviews = spark.createDataFrame([(i, f"f{i}", "FALSE_POSITIVE" if i < positives else triage.LABELS[i % 4 if i % 4 != 1 else 0]) for i in range(n)], "review_id long, finding_id string, label string")
    return triage.captured(reviews, featured), featured


def test_classifier_against_newton(spark):
    stored, featured = records(spark, 180, 50)
    fitted = triage.train(stored)
    assert (fitted.status, fitted.samples, fitted.positives) == ("TRAINED", 180, 50)
    strange = triage.features(spark.createDataFrame([finding("new", rule_id="never seen", language="never", sink_category="never", file_path="a/test_b.py", sanitized=False, evidence_type="deterministic")], FIELDS))
    ask = featured.unionByName(strange)
    got = {r["finding_id"]: r for r in fitted.predict(ask).collect()}
    seen = [r.asDict() for r in featured.collect()]
    asked = seen + [strange.first().asDict()]
    want = plain(seen, [int(s["finding_id"][1:]) < 50 for s in seen], asked)
    assert len(got) == 181
    for s, p in zip(asked, want, strict=True):
        r = got[s["finding_id"]]
        assert abs(r["fp_likelihood"] - p) < 2e-4 and r["fp_confidence"] == pytest.approx(min(1, abs(r["fp_likelihood"] - 0.5) * 2 + 0.3), abs=1e-4)
    assert got["new"]["factors"] == ["TEST_FILE"] and all("HEURISTIC" in r["factors"] for k, r in got.items() if k != "new")


@pytest.mark.parametrize(("n", "positives"), [(0, 0), (49, 20), (60, 9), (60, 51)])
def test_too_little_to_learn_from(spark, n, positives):
    stored, featured = records(spark, n, positives)
    fitted = triage.train(stored)
    assert (fitted.status, fitted.samples, fitted.positives, fitted.model) == ("INSUFFICIENT_DATA", n, positives, None)
    assert all(r["fp_likelihood"] is None and r["factors"] == [] for r in fitted.predict(featured).collect())


def test_least_that_is_enough(spark):
    assert triage.train(records(spark, 50, 10)[0]).status == "TRAINED"
