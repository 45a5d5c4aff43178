"""Findings: order, deduplication, filters, summaries, health, gates, suppressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import Dialect, native, operator, view
from girder.plans.ordered import placed
from girder.plans.scratch import Scratch

#: Ranks and penalties of severities.
RANK = "CASE {x} WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END"
PENALTY = "CASE {x} WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 0 END"
RULE_CAP = 45
GRADE = "CASE WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 70 THEN 'C' WHEN {x} >= 60 THEN 'D' ELSE 'F' END"


def rank(x: str) -> str:
    return RANK.format(x=x)


def penalty(x: str) -> str:
    return PENALTY.format(x=x)


def grade(x: str) -> str:
    return GRADE.format(x=x)


#: Findings of a rule after which its total has met the cap, whatever their severity: the least penalty is 2.
DECIDING = -(-RULE_CAP // 2)


def deductions(group: str = "repo_id", source: str = "{findings}") -> str:
    """Points of each finding: the running total of a rule stops at the cap.

    Only the first DECIDING penalised findings of a rule can have points. Spark finds those by a group limit before the
    shuffle, so that no task sorts all findings of a rule.
    """
    order = "file_path, line, coalesce(col, 0), input_pos"
    return f"""
SELECT {group}, category, rule_id, file_path, line, col, input_pos, severity, least({RULE_CAP}, cum) - least({RULE_CAP}, cum - pen) AS points
FROM (SELECT *, CAST(sum(pen) OVER (PARTITION BY {group}, category, rule_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group}, category, rule_id ORDER BY {order}) AS place FROM (SELECT *, {penalty("severity")} AS pen FROM {source}) p WHERE pen > 0) r WHERE place <= {DECIDING}) q) c"""


def subscores(group: str = "repo_id") -> str:
    """A score for each group and category that has findings."""
    return f"""
SELECT k.{group}, k.category, round(greatest(0.0, 100.0 - CAST(coalesce(d.points, 0) AS DOUBLE)), 2) AS score, CAST(coalesce(d.points, 0) AS BIGINT) AS deducted
FROM (SELECT DISTINCT {group}, category FROM {{findings}}) k LEFT JOIN (SELECT {group}, category, sum(points) AS points FROM ({deductions(group)}) x GROUP BY {group}, category) d ON d.{group} = k.{group} AND d.category = k.category"""


def _overall(group: str = "repo_id") -> str:
    return f"""
SELECT {group}, max(CASE WHEN category = 'SECURITY' THEN score END) AS s, max(CASE WHEN category = 'ARCHITECTURE' THEN score END) AS a FROM ({subscores(group)}) q GROUP BY {group}"""


@operator("a_04_health_subscore", "findings")
def a_04(d: Dialect) -> str:
    return subscores()


@operator("a_04_deductions", "findings")
def a_04_deductions(d: Dialect) -> str:
    return f"SELECT repo_id, category, rule_id, file_path, line, input_pos, CAST(points AS BIGINT) AS points FROM ({deductions()}) x WHERE points > 0"


@operator("a_05_overall_health", "findings")
def a_05(d: Dialect) -> str:
    return f"SELECT repo_id, round(0.55 * coalesce(s, 100.0) + 0.45 * coalesce(a, 100.0), 2) AS overall FROM ({_overall()}) o"


@operator("p_17_letter_grade", "findings")
def p_17(d: Dialect) -> str:
    return f"SELECT repo_id, overall, {grade('overall')} AS grade FROM (SELECT repo_id, round(0.55 * coalesce(s, 100.0) + 0.45 * coalesce(a, 100.0), 2) AS overall FROM ({_overall()}) o) g"


@operator("w_04_capped_running_sum", "findings")
def w_04(d: Dialect) -> str:
    return f"""
SELECT input_pos, rule_id, user_id, least({RULE_CAP}, CAST(sum({penalty("severity")}) OVER (PARTITION BY user_id, rule_id ORDER BY line, col, input_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)) AS running
FROM {{findings}}"""


@operator("a_06_security_summary", "findings")
def a_06(d: Dialect) -> str:
    counts = ", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
    return f"""
SELECT repo_id, count(*) AS total, {counts}, CAST(sum(CASE WHEN evidence_type = 'DETERMINISTIC' THEN 1 ELSE 0 END) AS BIGINT) AS n_deterministic, CAST(sum(CASE WHEN evidence_type = 'HEURISTIC' THEN 1 ELSE 0 END) AS BIGINT) AS n_heuristic
FROM {{findings}} WHERE category = 'SECURITY' GROUP BY repo_id"""


@operator("w_07_dedup_keep_first", "findings")
def w_07(d: Dialect) -> str:
    return """
SELECT input_pos, rule_id, file_path, line, col, snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, line, coalesce(col, 0), snippet ORDER BY input_pos) AS k FROM {findings}) r
WHERE k = 1"""


@operator("f_01_cli_post_filter", "findings")
def f_01(d: Dialect) -> str:
    return f"""
SELECT input_pos, rule_id, severity, file_path, line FROM {{findings}}
WHERE category = 'SECURITY' AND {rank("severity")} >= {rank("'MEDIUM'")} AND upper(rule_id) IN ('ERROR', 'PURCHASE') ORDER BY {rank("severity")} DESC, file_path, line, rule_id"""


@operator("f_10_trend_filters", "findings")
def f_10(d: Dialect) -> str:
    return "SELECT id, repo_id, day FROM {findings} WHERE repo_id = 'repo1' AND day >= '2024-01-15'"


@operator("f_12_console_filters", "findings")
def f_12(d: Dialect) -> str:
    return "SELECT id, rule_id, file_path FROM {findings} WHERE (position('purch' IN lower(rule_id)) > 0 OR position('user/1' IN lower(file_path)) > 0) AND severity = 'HIGH'"


@operator("f_14_secret_presence", "texts")
def f_14(d: Dialect) -> str:
    return f"SELECT doc_id FROM {{texts}} WHERE {d.has('text', SECRET_ANY)}"


#: Shapes of secrets.
SECRET_ANY = r"(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|Bearer [A-Za-z0-9._-]{16,}|(password|secret|token|api_key) *= *\"[^\"]{6,}\")"


@operator("f_16_exit_code", "findings")
def f_16(d: Dialect) -> str:
    return f"SELECT repo_id, CASE WHEN max({rank('severity')}) >= 5 THEN 2 ELSE 0 END AS exit_code FROM {{findings}} GROUP BY repo_id"


#: The orders of the engine, the command line and the console.
ORDERS = {
    "o_01_engine_order": ("file_path", "line", "coalesce(col, 0)", "rule_id", "input_pos"),
    "o_02_cli_order": (f"-{rank('severity')}", "file_path", "line", "rule_id", "input_pos"),
    "o_10_console_sort": ("rule_id", "line", "input_pos"),
}


def in_order(findings: DataFrame, order: str) -> DataFrame:
    """(input_pos, place): the place of each finding in an order of the whole run, from 1."""
    rows = placed(findings, Scratch(findings.sparkSession, "order"), "findings", [F.expr(x) for x in ORDERS[order]])
    return rows.select("input_pos", (F.col("place") + 1).alias("place"))


for _id, _keys in ORDERS.items():

    @native(_id, "findings", sql=f"SELECT input_pos, row_number() OVER (ORDER BY {', '.join(_keys)}) AS place FROM {{findings}}")
    def _ordered(spark: SparkSession, sf_dir: str, order: str = _id) -> DataFrame:
        return in_order(view(spark, sf_dir, "findings"), order)


@operator("o_08_report_top_k", "findings")
def o_08(d: Dialect) -> str:
    return f"SELECT input_pos, rule_id, severity, file_path, line FROM {{findings}} ORDER BY {rank('severity')} DESC, file_path, line, rule_id, input_pos LIMIT 25"


@operator("u_01_union_all", "findings")
def u_01(d: Dialect) -> str:
    return "SELECT id, category FROM {findings} WHERE category = 'SECURITY' UNION ALL SELECT id, category FROM {findings} WHERE category = 'ARCHITECTURE'"


@operator("p_18_severity_levels", "findings")
def p_18(d: Dialect) -> str:
    sarif = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
    gitlab = "CASE severity WHEN 'CRITICAL' THEN 'blocker' WHEN 'HIGH' THEN 'critical' WHEN 'MEDIUM' THEN 'major' WHEN 'LOW' THEN 'minor' ELSE 'info' END"
    return f"SELECT id, {rank('severity')} AS sev_rank, {sarif} AS sarif_level, {gitlab} AS gitlab_level FROM {{findings}}"


@operator("p_19_priority", "findings")
def p_19(d: Dialect) -> str:
    base = f"""CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END
 + CASE confidence WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 12 ELSE 5 END + round(40.0 * least(1.0, greatest(0.0, value / 200.0)), 4)"""
    score = f"round(least(100.0, greatest(0.0, ({base}) * CASE user_id % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 ELSE 0.8 END)), 2)"
    return f"SELECT id, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT id, CAST({score} AS DOUBLE) AS score FROM {{findings}}) s"


#: Weights of the exploitability factors.
EXPLOIT = ((0.25, "surface", {"PUBLIC": 1.0, "INTERNAL": 0.4, "UNKNOWN": 0.5}), (0.20, "auth", {"NONE": 1.0, "REQUIRED": 0.2, "UNKNOWN": 0.6}), (0.15, "authz", {"NONE": 1.0, "REQUIRED": 0.2, "UNKNOWN": 0.6}), (0.20, "input", {"DIRECT": 1.0, "FILTERED": 0.3, "UNKNOWN": 0.5}), (0.20, "reach", {"DIRECT": 1.0, "GUARDED": 0.4, "UNKNOWN": 0.5}))


@operator("p_20_exploitability", "findings")
def p_20(d: Dialect) -> str:
    terms, cols = [], []
    for i, (w, name, table) in enumerate(EXPLOIT):
        known = [k for k in table if k != "UNKNOWN"]
        cols.append(f"CASE (input_pos + {i}) % 3 WHEN 0 THEN '{known[0]}' WHEN 1 THEN '{known[1]}' ELSE 'UNKNOWN' END AS {name}")
        terms.append(f"CAST({w} AS DOUBLE) * CAST(CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items() if k != "UNKNOWN") + f" ELSE {table['UNKNOWN']} END AS DOUBLE)")
    return f"SELECT id, round({' + '.join(terms)}, 4) AS exploitability FROM (SELECT id, {', '.join(cols)} FROM {{findings}}) f"


@operator("p_24_trend_key", "findings")
def p_24(d: Dialect) -> str:
    return "SELECT id, CASE WHEN trim(snippet) <> '' THEN concat_ws('::', rule_id, lower(file_path), trim(snippet)) ELSE concat_ws('::', rule_id, lower(file_path), CAST(coalesce(line, 0) AS STRING)) END AS trend_key FROM {findings}"


@operator("p_06_fingerprints", "findings")
def p_06(d: Dialect) -> str:
    primary = d.sha("concat_ws(':', rule_id, lower(file_path), snippet)")
    location = d.sha("concat_ws(':', rule_id, lower(file_path), CAST(line AS STRING), CAST(coalesce(col, 0) AS STRING))")
    return f"SELECT id, {primary} AS primary_hash, {location} AS location_hash, concat('fp_', rule_id, '_', substr({primary}, 1, 12)) AS stable_id FROM {{findings}}"


@operator("a_01_language_distribution", "texts")
def a_01(d: Dialect) -> str:
    return "SELECT lang, count(*) AS files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS loc FROM {texts} GROUP BY lang"


@operator("a_26_page_totals", "orders_v")
def a_26(d: Dialect) -> str:
    return "SELECT o_orderkey, total FROM (SELECT o_orderkey, count(*) OVER () AS total, o_orderdate FROM (SELECT * FROM {orders_v} WHERE o_orderstatus = 'P') s) t ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"


@operator("o_06_offset_page", "orders_v")
def o_06(d: Dialect) -> str:
    return "SELECT o_orderkey, o_orderdate FROM {orders_v} ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100"


@operator("w_05_latest_per_group", "orders_v")
def w_05(d: Dialect) -> str:
    return "SELECT o_custkey, max_by(o_orderkey, struct_key) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, concat(CAST(o_orderdate AS STRING), '|', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS struct_key FROM {orders_v}) o GROUP BY o_custkey"


@operator("w_06_first_match", "findings")
def w_06(d: Dialect) -> str:
    return "SELECT file_path, min_by(rule_id, input_pos) AS first_rule, min(input_pos) AS first_pos FROM {findings} GROUP BY file_path"


@operator("w_10_severity_trajectories", "findings")
def w_10(d: Dialect) -> str:
    return f"SELECT severity, {d.joined('point', ';')} AS trajectory FROM (SELECT severity, concat(CAST(day AS STRING), '=', CAST(count(*) AS STRING)) AS point FROM {{findings}} GROUP BY severity, day) p GROUP BY severity"


@operator("a_19_gate_verdict", "findings")
def a_19(d: Dialect) -> str:
    return """
SELECT repo_id, blocking, advisory, CASE WHEN blocking > 0 THEN 'FAIL' WHEN advisory > 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT repo_id, CAST(sum(CASE WHEN severity IN ('CRITICAL', 'HIGH') AND day = '2024-01-30' THEN 1 ELSE 0 END) AS BIGINT) AS blocking, CAST(sum(CASE WHEN severity = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS advisory FROM {findings} GROUP BY repo_id) g"""


@operator("a_30_chart_totals", "findings")
def a_30(d: Dialect) -> str:
    return "SELECT day, count(*) AS total, max(count(*)) OVER () AS top FROM {findings} GROUP BY day"


#: Suppressions used by the queries below.
SUPPRESSIONS = """
SELECT * FROM (VALUES
 (0, 'RULE', 'click', CAST(NULL AS STRING), CAST(NULL AS STRING), DATE '2024-01-10'),
 (1, 'FILE', CAST(NULL AS STRING), 'user/7', CAST(NULL AS STRING), CAST(NULL AS DATE)),
 (2, 'RULE_IN_FILE', 'error', 'user/8', CAST(NULL AS STRING), CAST(NULL AS DATE)),
 (3, 'FINDING', CAST(NULL AS STRING), CAST(NULL AS STRING), 'F100', CAST(NULL AS DATE)),
 (4, 'RULE', 'view', CAST(NULL AS STRING), CAST(NULL AS STRING), DATE '2024-12-31')) AS s(ord, scope, rule, file, finding, expires)"""


@operator("j_03_suppression_match", "findings")
def j_03(d: Dialect) -> str:
    """First match in suppression order: four equi-joins instead of one join on a disjunction."""
    arms = (("RULE", "f.rule_id = s.rule"), ("FILE", "f.file_path = s.file"), ("RULE_IN_FILE", "f.rule_id = s.rule AND f.file_path = s.file"), ("FINDING", "f.id = s.finding"))
    union = " UNION ALL ".join(f"SELECT f.id, s.ord, s.expires FROM {{findings}} f JOIN ({SUPPRESSIONS}) s ON s.scope = '{k}' AND {on}" for k, on in arms)
    return f"SELECT id, min(ord) AS suppression, min_by(CASE WHEN expires IS NOT NULL AND DATE '2024-06-01' > expires THEN 'EXPIRED' ELSE 'SUPPRESSED' END, ord) AS state FROM ({union}) m GROUP BY id"


@operator("f_04_suppression_states", "findings")
def f_04(d: Dialect) -> str:
    return f"SELECT f.id, s.ord, CASE WHEN s.expires IS NOT NULL AND f.day > CAST(s.expires AS STRING) THEN 'EXPIRED_SUPPRESSION' ELSE 'SUPPRESSED' END AS state FROM {{findings}} f JOIN ({SUPPRESSIONS}) s ON s.scope = 'RULE' AND f.rule_id = s.rule"


@operator("f_05_central_suppressions", "fleet")
def f_05(d: Dialect) -> str:
    rows = "SELECT * FROM (VALUES (0, 0, '*', DATE '2030-01-01'), (1, 1, '5', DATE '2030-01-01'), (2, 2, '*', DATE '2020-01-01')) AS s(ord, org, repo, expires)"
    return f"SELECT f.repo_id, s.ord FROM {{fleet}} f JOIN ({rows}) s ON f.organisation = s.org AND s.expires > DATE '2024-06-01' AND (s.repo = '*' OR s.repo = CAST(f.repo_id AS STRING))"


@operator("j_04_source_boundary_band", "findings")
def j_04(d: Dialect) -> str:
    """A band join on lines two apart at most: an equi-join on (file, bucket of three lines) over the neighbouring buckets."""
    b = "SELECT input_pos, file_path, line, CAST(floor(line / 3.0) AS INT) + k AS bucket FROM {findings} CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) AS v(k)) o WHERE rule_id = 'view'"
    return f"""
SELECT s.input_pos, min(b.input_pos) AS boundary FROM (SELECT input_pos, file_path, line, CAST(floor(line / 3.0) AS INT) AS bucket FROM {{findings}} WHERE rule_id = 'error') s
JOIN ({b}) b ON s.file_path = b.file_path AND s.bucket = b.bucket AND abs(s.line - b.line) <= 2 GROUP BY s.input_pos"""


@operator("j_05_enclosing_function", "findings", "functions")
def j_05(d: Dialect) -> str:
    """An interval join inside a file: functions are dealt to the buckets of 64 lines that they touch; the first in order wins."""
    touched = "explode(sequence(CAST(floor(line_start / 64.0) AS INT), CAST(floor(line_end / 64.0) AS INT)))" if d.name == "spark" else "unnest(range(CAST(floor(line_start / 64.0) AS INT), CAST(floor(line_end / 64.0) AS INT) + 1))"
    return f"""
SELECT f.input_pos, min(g.fn) AS fn FROM (SELECT input_pos, line, CAST(user_id % 40 AS INT) AS file_id, CAST(floor(line / 64.0) AS INT) AS bucket FROM {{findings}}) f
JOIN (SELECT fn, file_id, line_start, line_end, {touched} AS bucket FROM {{functions}}) g ON f.file_id = g.file_id AND f.bucket = g.bucket AND f.line BETWEEN g.line_start AND g.line_end GROUP BY f.input_pos"""


@operator("s_16_inline_suppressions", "texts")
def s_16(d: Dialect) -> str:
    lines = d.each(d.split("text", "\\n"), "l")
    return f"""
SELECT doc_id, line, rule, reason FROM (
  SELECT doc_id, CAST(l.pos + 1 AS BIGINT) AS line, {d.get("l.x", '(token|password|License)')} AS rule, {d.get("l.x", '= "([^"]*)"')} AS reason FROM {{texts}} {lines}) s
WHERE rule <> ''"""
