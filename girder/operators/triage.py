"""Triage of findings: their 18 features, reviewers' verdicts, and a classifier of false positives trained on these.

The queries' findings are the nearest paths across functions (``summaries.nearest``), so depths, sinks and sanitizers are those that the
analysis found, tiers and instability those of the import graph; verdicts come with the calls that were reviewed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import graph, summaries
from girder.plans.operator import DUCK, SPARK, native, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View

#: Marks of test files; the features, categories and numbers; labels that may be stored; least samples, in all and a class.
TEST_MARKS = ("/test/", "/tests/", "/testing/", "test_", "_test.", "/fixtures/", "/mocks/", "/spec/", "/specs/")
CATEGORICAL = ("rule_id", "language", "source_boundary", "sink_category", "layer", "evidence_type")
NUMERIC = ("severity_rank", "confidence_rank", "category_is_security", "sanitizer_detected", "taint_depth", "call_depth", "path_certainty", "instability", "is_test_file", "historical_rule_fp_rate", "has_prior_suppression", "file_depth")
LABELS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "ACCEPTED_RISK", "SUSPECT_HEURISTIC")
LEAST, LEAST_A_CLASS, ITERATIONS = 50, 10, 500
#: Ranks, and what stands for an attribute that a finding does not have.
SEVERITIES, CONFIDENCES = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}, {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
MISSING = {"rule_id": "UNKNOWN", "language": "plaintext", "severity": "MEDIUM", "confidence": "MEDIUM", "category": "SECURITY", "file_path": "", "evidence_type": "DETERMINISTIC", "source_boundary": "NONE", "sink_category": "NONE", "sanitized": False, "taint_depth": 0, "call_depth": 0, "path_certainty": 1.0}

# reviews: an order's next line says what came of the call that the two lines before it make
VIEWS["reviews"] = View(
    ("lineitem",),
    """
SELECT a.l_orderkey * 10 + a.l_linenumber AS review_id, a.l_partkey AS source_fn, b.l_partkey AS callee,
       CASE WHEN a.l_returnflag = 'R' THEN ' false_positive' WHEN a.l_returnflag = 'A' THEN 'TRUE_POSITIVE' WHEN a.l_linestatus = 'O' THEN 'Accepted_Risk ' ELSE 'unsure' END AS label
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey""".strip(),
)


def _rank(x: Column, ranks: dict[str, int], other: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair]), F.upper(x)), F.lit(other))


def features(findings: DataFrame, components: DataFrame | None = None, history: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """(finding_id, the 18 features): nothing of them is source text or a name from it.

    ``findings``: ``finding_id`` and whatever of the attributes in ``MISSING`` is known, ``component`` and the ``layer`` of its file;
    absent columns and nulls take the values there. ``components`` (component, layer, instability), ``history`` (rule_id, fp_rate) and
    ``suppressed`` (finding_id) are joined by key, the first two a row a key; a finding without a layer has its component's, and without a
    match that is UNKNOWN, at an instability of 0.5, with no history. Repeated findings give a row each; further columns are left out.
    """
    held = set(findings.columns)
    known = {c: F.coalesce(F.col(c), F.lit(v)) if c in held else F.lit(v) for c, v in MISSING.items()}
    path = F.regexp_replace(F.regexp_replace(known["file_path"], r"\\", "/"), "^/+|/+$", "")
    f = findings.select(
        "finding_id",
        (F.col("component") if "component" in held else F.lit(None).cast("long")).alias("component"),
        (F.col("layer") if "layer" in held else F.lit(None).cast("string")).alias("__layer"),
        known["rule_id"].alias("rule_id"),
        F.lower(known["language"]).alias("language"),
        _rank(known["severity"], SEVERITIES, 2).alias("severity_rank"),
        _rank(known["confidence"], CONFIDENCES, 1).alias("confidence_rank"),
        (F.upper(known["category"]) == "SECURITY").cast("int").alias("category_is_security"),
        F.upper(known["evidence_type"]).alias("evidence_type"),
        known["source_boundary"].alias("source_boundary"),
        known["sink_category"].alias("sink_category"),
        known["sanitized"].cast("int").alias("sanitizer_detected"),
        known["taint_depth"].cast("int").alias("taint_depth"),
        known["call_depth"].cast("int").alias("call_depth"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), known["path_certainty"].cast("double"))).alias("path_certainty"),
        reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(m)) for m in TEST_MARKS]).cast("int").alias("is_test_file"),
        F.size(F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))).alias("file_depth"),
    )
    none = f.where("false")
    components = none.select("component", F.lit("").alias("layer"), F.lit(0.5).alias("instability")) if components is None else components.select("component", "layer", "instability")
    history = none.select("rule_id", F.lit(0.0).alias("fp_rate")) if history is None else history.select("rule_id", "fp_rate")
    suppressed = none.select("finding_id") if suppressed is None else suppressed.select("finding_id").distinct()
    f = f.join(components, "component", "left").join(history, "rule_id", "left").join(suppressed.withColumn("__held", F.lit(1)), "finding_id", "left")
    return f.select(
        "finding_id", *[c for c in CATEGORICAL if c != "layer"], F.coalesce("__layer", "layer", F.lit("UNKNOWN")).alias("layer"),
        *[c for c in NUMERIC if c not in ("instability", "historical_rule_fp_rate", "has_prior_suppression")],
        F.round(F.coalesce("instability", F.lit(0.5)), 4).alias("instability"), F.round(F.coalesce("fp_rate", F.lit(0.0)), 4).alias("historical_rule_fp_rate"), F.coalesce("__held", F.lit(0)).alias("has_prior_suppression"),
    )


def captured(reviews: DataFrame, featured: DataFrame) -> DataFrame:
    """(review_id, finding_id, label, status, features): a verdict is stored with the features that its finding has now.

    Labels are trimmed and upper-cased; ``status`` is STORED, UNKNOWN_LABEL for one that is null or not allowed, or else UNKNOWN_FINDING, and
    features are null unless it is stored. Each review gives a row: a finding has one row in ``featured``.
    """
    snapshot = featured.select("finding_id", F.struct(*CATEGORICAL, *NUMERIC).alias("features"))
    label = F.upper(F.trim("label"))
    status = F.when(~F.coalesce(label.isin(*LABELS), F.lit(False)), "UNKNOWN_LABEL").when(F.col("features").isNull(), "UNKNOWN_FINDING").otherwise("STORED")
    rows = reviews.select("review_id", "finding_id", label.alias("label"))
    # most reviews may be of no finding: without a key they match nothing, and would meet in one task
    none = rows.where("finding_id is null").withColumn("features", F.lit(None).cast(snapshot.schema["features"].dataType))
    rows = rows.where("finding_id is not null").join(snapshot, "finding_id", "left").unionByName(none).withColumn("status", status)
    return rows.select("review_id", "finding_id", "label", "status", F.when(F.col("status") == "STORED", F.col("features")).alias("features"))


@dataclass(frozen=True)
class Classifier:
    """``model`` is None where there was too little to learn from."""

    status: str
    samples: int
    positives: int
    model: PipelineModel | None = None

    def predict(self, featured: DataFrame) -> DataFrame:
        """(finding_id, status, fp_likelihood, fp_confidence, factors): likelihood to four places, confidence by its distance from a half."""
        if self.model is None:
            return featured.select("finding_id", F.lit(self.status).alias("status"), F.lit(None).cast("double").alias("fp_likelihood"), F.lit(None).cast("double").alias("fp_confidence"), F.array().cast("array<string>").alias("factors"))
        p = F.col("fp_likelihood")
        said = (("TEST_FILE", F.col("is_test_file") == 1), ("SANITIZED", F.col("sanitizer_detected") == 1), ("RULE_OFTEN_WRONG", F.col("historical_rule_fp_rate") > 0.6), ("HEURISTIC", F.col("evidence_type") == "HEURISTIC"))
        factors = F.array_compact(F.array(*[F.when(when, name) for name, when in said]))
        rows = self.model.transform(featured).withColumn("fp_likelihood", F.round(vector_to_array("probability")[1], 4)).withColumn("factors", factors)
        factors = F.when(F.size("factors") > 0, F.col("factors")).when(p > 0.5, F.array(F.lit("LIKE_FALSE_POSITIVES"))).otherwise(F.array(F.lit("EVIDENCE_OF_DEFECT")))
        return rows.select("finding_id", F.lit("AVAILABLE").alias("status"), "fp_likelihood", F.round(F.least(F.lit(1.0), F.abs(p - 0.5) * 2 + 0.3), 4).alias("fp_confidence"), factors.alias("factors"))


def train(records: DataFrame, c: float = 1.0) -> Classifier:
    """Balanced logistic regression over stored verdicts (``captured``): false positives against all other labels.

    The loss of all samples, a class weighing as much as the other, plus half the squared weights over ``c``; the intercept is free and
    nothing is scaled, so Spark's penalty on the mean loss is 1 / (c * samples). Values of a category that training did not see add nothing.
    All stored rows are used, in as many passes as it takes; the driver gets counts, the categories' values (rules, tiers, kinds of
    evidence: as many as the catalogs have) and the weights. Fewer than 50 samples, or 10 of a class, train nothing.
    """
    rows = records.where("features is not null").select(F.col("features.*"), (F.col("label") == "FALSE_POSITIVE").cast("double").alias("y"))
    rows = Scratch(records.sparkSession, "triage").save(rows, "records")
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)).cast("long")).first()
    if n < LEAST or min(positives, n - positives) < LEAST_A_CLASS:
        return Classifier("INSUFFICIENT_DATA", n, positives)
    weighted = rows.withColumn("w", F.when(F.col("y") == 1, n / (2 * positives)).otherwise(n / (2 * (n - positives))))
    indexes, vectors = [f"{x}_index" for x in CATEGORICAL], [f"{x}_vector" for x in CATEGORICAL]
    stages = [
        StringIndexer(inputCols=list(CATEGORICAL), outputCols=indexes, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexes, outputCols=vectors),
        VectorAssembler(inputCols=[*vectors, *NUMERIC], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (c * n), standardization=False, maxIter=ITERATIONS, tol=1e-9),
    ]
    return Classifier("TRAINED", n, positives, Pipeline(stages=stages).fit(weighted))


# the queries: paths as findings, verdicts on their calls

_ID = "concat(CAST(source_fn AS STRING), '>', CAST(callee AS STRING), ':', category)"
_COMPONENTS = lambda d: f"SELECT s.component, s.instability FROM ({graph.a_10.text(d)}) s"


def path_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the paths across functions, at the file of the sink."""
    rel = {x: view(spark, sf_dir, x) for x in ("modules", "source_calls")}
    paths = Scratch(spark, "path-findings").save(summaries.nearest(spark, sf_dir), "paths")
    return spark.sql(_FINDINGS.format(tiers=graph.tiers(SPARK, "{modules}", key="id").replace("{modules}", "\x00")).replace("\x00", "{modules}"), paths=paths, **rel)


_FINDINGS = f"""
WITH t AS ({{tiers}}), clean AS (SELECT fn, callee, max(clean) <> 0 AS sanitized FROM {{{{source_calls}}}} GROUP BY fn, callee)
SELECT {_ID.replace("source_fn", "p.source_fn").replace("callee", "p.callee")} AS finding_id, p.source_fn, p.callee, CASE category WHEN 'SQL' THEN 'SEC-PY-011' WHEN 'COMMAND' THEN 'SEC-PY-012' WHEN 'DOM' THEN 'SEC-JS-009' ELSE 'SEC-JS-010' END AS rule_id,
 CASE WHEN category IN ('SQL', 'COMMAND') THEN 'Python' ELSE 'JavaScript' END AS language, CASE WHEN category = 'DOM' THEN 'high' ELSE 'critical' END AS severity, CASE WHEN depth = 1 THEN 'HIGH' WHEN depth <= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 m.path AS file_path, m.component, t.tier AS layer, CASE WHEN depth = 1 THEN 'DETERMINISTIC' ELSE 'HEURISTIC' END AS evidence_type, CASE s.tier WHEN 'PRESENTATION' THEN 'NETWORK' WHEN 'INFRASTRUCTURE' THEN 'DATABASE' ELSE 'NONE' END AS source_boundary,
 category AS sink_category, c.sanitized, depth + 2 AS taint_depth, depth AS call_depth, CAST(1 AS DOUBLE) / depth AS path_certainty
FROM {{{{paths}}}} p JOIN {{{{modules}}}} m ON m.id = p.sink_fn JOIN clean c ON c.fn = p.source_fn AND c.callee = p.callee LEFT JOIN t ON t.id = p.sink_fn LEFT JOIN t s ON s.id = p.source_fn"""


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The features of all findings, and all reviews by finding; a review of a call that no finding is of has none."""
    scratch = Scratch(spark, "triage-given")
    found = scratch.save(path_findings(spark, sf_dir), "findings")
    reviews = scratch.save(view(spark, sf_dir, "reviews").join(found.select("source_fn", "callee", "finding_id", "rule_id"), ["source_fn", "callee"], "left"), "reviews")
    label = F.upper(F.trim("label"))
    stored = reviews.where(F.col("finding_id").isNotNull() & label.isin(*LABELS))
    history = stored.groupBy("rule_id").agg(F.avg((label == "FALSE_POSITIVE").cast("double")).alias("fp_rate"))
    components = spark.sql(graph.a_10.text(SPARK), component_edges=view(spark, sf_dir, "component_edges"), modules=view(spark, sf_dir, "modules"))
    components = components.select("component", F.lit(None).cast("string").alias("layer"), "instability")
    return scratch.save(features(found, components, history, stored.where(label == "ACCEPTED_RISK")), "features"), reviews


_INPUTS = ("own_flows", "call_flows", "source_calls", "modules", "component_edges", "reviews")
_REVIEWED = "SELECT r.review_id, f.finding_id, f.rule_id, upper(trim(r.label)) AS label FROM {reviews} r LEFT JOIN f ON f.source_fn = r.source_fn AND f.callee = r.callee"
_FOUND = _FINDINGS.format(tiers=graph.tiers(DUCK, "{modules}", key="id").replace("{modules}", "\x00")).replace("\x00", "{modules}").replace("{paths}", f"({summaries._PATHS})")
_STORED = "(" + ", ".join(f"'{x}'" for x in LABELS) + ")"
_FEATURES = f"""WITH f AS ({_FOUND}), r AS ({_REVIEWED}), s AS (SELECT * FROM r WHERE finding_id IS NOT NULL AND label IN {_STORED})
SELECT f.finding_id, f.rule_id, lower(language) AS language, CASE severity WHEN 'critical' THEN 4 ELSE 3 END AS severity_rank, CASE confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS confidence_rank, 1 AS category_is_security, evidence_type,
 source_boundary, sink_category, CAST(sanitized AS INTEGER) AS sanitizer_detected, taint_depth, call_depth, path_certainty, coalesce(layer, 'UNKNOWN') AS layer, i.instability, CASE WHEN {" OR ".join(f"contains(lower(file_path), '{m}')" for m in TEST_MARKS)} THEN 1 ELSE 0 END AS is_test_file,
 coalesce(h.rate, 0) AS historical_rule_fp_rate, CASE WHEN f.finding_id IN (SELECT finding_id FROM s WHERE label = 'ACCEPTED_RISK') THEN 1 ELSE 0 END AS has_prior_suppression, CAST(len(string_split(file_path, '/')) AS INTEGER) AS file_depth
FROM f JOIN ({_COMPONENTS(DUCK)}) i ON i.component = f.component LEFT JOIN (SELECT rule_id, round(avg(CASE WHEN label = 'FALSE_POSITIVE' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM s GROUP BY rule_id) h ON h.rule_id = f.rule_id"""


@native("p_23_features", *_INPUTS, sql=_FEATURES)
def p_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 features of each finding."""
    return _given(spark, sf_dir)[0]


@native("l_04_feedback", *_INPUTS, sql=f"WITH f AS ({_FOUND}), r AS ({_REVIEWED}) SELECT review_id, finding_id, label, CASE WHEN label NOT IN {_STORED} THEN 'UNKNOWN_LABEL' WHEN finding_id IS NULL THEN 'UNKNOWN_FINDING' ELSE 'STORED' END AS status FROM r")
def l_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of reviewers: stored with their finding's features, or refused and why."""
    featured, reviews = _given(spark, sf_dir)
    return captured(reviews, featured).select("review_id", "finding_id", "label", "status")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[Classifier, DataFrame, DataFrame]:
    featured, reviews = _given(spark, sf_dir)
    records = captured(reviews, featured)
    return train(records), featured, records


@native("l_01_triage_classifier")
def l_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training came to: samples, false positives among them, and the share of samples that the classifier gets right."""
    fitted, featured, records = _trained(spark, sf_dir)
    met = fitted.predict(featured).join(records.where("status = 'STORED'").select("finding_id", "label"), "finding_id")
    right = ((F.col("fp_likelihood") > 0.5) == (F.col("label") == "FALSE_POSITIVE")).cast("double")
    return met.agg(F.lit(fitted.status).alias("status"), F.lit(fitted.samples).cast("long").alias("samples"), F.lit(fitted.positives).cast("long").alias("false_positives"), F.round(F.avg(right), 4).alias("training_accuracy"))


@native("l_02_triage_predict")
def l_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each finding is a false positive, and why."""
    fitted, featured, _ = _trained(spark, sf_dir)
    return fitted.predict(featured).withColumn("factors", F.array_join("factors", ","))
