"""Sinks: table writers, and report documents built from findings.

Anything that grows with the findings is written by Spark: a JSON or text row a finding, in files, or one document
written by tasks (``report``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import native, view
from girder.plans.scratch import Scratch
from girder.sources import report

#: Rows a sheet may hold.
SHEET_ROWS = 1_048_576
RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
#: CWE numbers of the rules in reports.
CWE = {"error": 703, "purchase": 840, "view": 79, "click": 352, "login": 287, "signup": 287}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_path", "line", F.coalesce("col", F.lit(0)), "rule_id", "input_pos")


def top(findings: DataFrame, n: int) -> list[dict]:
    """The first rows in report order: a top-k, not a sort of all rows."""
    return [r.asDict() for r in ordered(findings).limit(n).collect()]


def json_rows(findings: DataFrame) -> DataFrame:
    """A canonical JSON text a finding: keys in order."""
    cols = sorted(("rule_id", "file_path", "line", "col", "severity", "category", "snippet"))
    return findings.select("input_pos", F.to_json(F.struct(*cols)).alias("value"))


def sarif_rows(findings: DataFrame, key: str = "input_pos") -> DataFrame:
    level = F.create_map(*[F.lit(x) for p in LEVEL.items() for x in p])[F.col("severity")]
    region = F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return findings.select(key, F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"), place.alias("locations"))).alias("value"))


def gitlab_rows(findings: DataFrame, key: str = "input_pos") -> DataFrame:
    place = F.struct(F.col("file_path").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines"))
    return findings.select(key, F.to_json(F.struct(F.col("snippet").alias("description"), F.col("rule_id").alias("check_name"), F.col("id").alias("fingerprint"), F.lower("severity").alias("severity"), place.alias("location"))).alias("value"))


def cyclonedx_rows(findings: DataFrame, key: str = "input_pos") -> DataFrame:
    cwe = F.create_map(*[F.lit(x) for p in CWE.items() for x in p])[F.col("rule_id")]
    return findings.select(key, F.to_json(F.struct(F.col("id"), F.array(cwe).alias("cwes"), F.array(F.struct(F.lower("severity").alias("severity"))).alias("ratings"))).alias("value"))


def markdown(findings: DataFrame, n: int = 25) -> str:
    lines = ["| Severity | Rule | Place |", "|---|---|---|"]
    return "\n".join(lines + [f"| {x['severity']} | {x['rule_id']} | {x['file_path']}:{x['line']} |" for x in top(findings, n)]) + "\n"


def save_snapshot(findings: DataFrame, folder: str) -> None:
    """Append-only facts by repository, secrets redacted at the boundary."""
    redacted = findings.withColumn("snippet", F.regexp_replace("snippet", r'(?i)((password|secret|token|api_key) *= *)"[^"]+"', '$1"***"'))
    redacted.write.mode("append").partitionBy("repo_id").parquet(folder)


def save_audit_log(events: DataFrame, folder: str) -> None:
    """A sorted-key JSON line an event."""
    events.select(F.to_json(F.struct(*sorted(events.columns)))).write.mode("overwrite").text(folder)


_LEVEL_SQL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
_CWE_SQL = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CWE.items()) + " END"
for _id, _rows, _sql in (
    ("k_01_json_rows", json_rows, "json_object('category', category, 'col', col, 'file_path', file_path, 'line', line, 'rule_id', rule_id, 'severity', severity, 'snippet', snippet)"),
    ("k_02_sarif_rows", sarif_rows, f"json_object('ruleId', rule_id, 'level', {_LEVEL_SQL}, 'message', json_object('text', snippet), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file_path), 'region', json_object('startLine', line, 'startColumn', col + 1)))))"),
    ("k_06_gitlab_rows", gitlab_rows, "json_object('description', snippet, 'check_name', rule_id, 'fingerprint', id, 'severity', lower(severity), 'location', json_object('path', file_path, 'lines', json_object('begin', line)))"),
    ("k_07_cyclonedx_rows", cyclonedx_rows, f"json_object('id', id, 'cwes', json_array({_CWE_SQL}), 'ratings', json_array(json_object('severity', lower(severity))))"),
):

    @native(_id, "findings", sql=f"SELECT input_pos, CAST({_sql} AS VARCHAR) AS value FROM {{findings}}")
    def _written(spark: SparkSession, sf_dir: str, rows=_rows) -> DataFrame:
        return rows(view(spark, sf_dir, "findings"))


#: Sheets of a workbook.
SHEETS = ("Summary", "Findings", "By rule", "By file", "Remediation")


def workbook(findings: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a full workbook as tables; ``excel`` writes the findings' sheet, the others are small by their groups."""
    by = lambda *c: findings.groupBy(*c).agg(F.count("*").alias("n"))
    return {
        "Summary": by("severity", "category"),
        "Findings": findings.select("severity", "rule_id", "file_path", "line"),
        "By rule": by("rule_id", "severity"),
        "By file": by("file_path"),
        "Remediation": by("rule_id").withColumn("cwe", F.create_map(*[F.lit(x) for p in CWE.items() for x in p])[F.col("rule_id")]),
    }


def sheet_rows(findings: DataFrame) -> DataFrame:
    """(sheet, cells): every row of every sheet with its cells made harmless, as text."""
    out: DataFrame | None = None
    for name, rows in workbook(findings).items():
        cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[^\t\n\r -퟿]", ""), F.lit("")) for c in rows.columns]
        safe = F.array(*[F.when(c.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c) for c in cells])
        part = rows.select(F.lit(name).alias("sheet"), F.array_join(safe, "|").alias("cells"))
        out = part if out is None else out.union(part)
    return out


def html_rows(findings: DataFrame, key: str = "input_pos") -> DataFrame:
    """(key, value): a table row a finding, escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return findings.select(key, F.concat(F.lit("<tr><td>"), esc("severity"), F.lit("</td><td>"), esc("rule_id"), F.lit("</td><td>"), esc("file_path"), F.lit(":"), esc("line"), F.lit("</td></tr>")).alias("value"))


def snapshot_tables(findings: DataFrame) -> dict[str, DataFrame]:
    """What one run leaves: a snapshot row a repository, its findings with secrets redacted, deductions by rule, components, and edges between them."""
    redacted = F.regexp_replace("snippet", r'(?i)((password|secret|token|api_key) *= *)"[^"]+"', '$1"***"')
    component = F.regexp_extract("file_path", "^([^/]+)/", 1)
    points = F.create_map(*[F.lit(x) for p in {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 5, "LOW": 2, "INFO": 0}.items() for x in p])[F.col("severity")]
    return {
        "snapshots": findings.groupBy("repo_id").agg(F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == k).alias(f"{k.lower()}_count") for k in RANK]),
        "findings": findings.withColumn("snippet", redacted),
        "deductions": findings.groupBy("repo_id", "rule_id").agg(F.least(F.lit(45), F.sum(points)).alias("points")),
        "components": findings.groupBy("repo_id", component.alias("component")).agg(F.countDistinct("file_path").alias("file_count")),
        "edges": findings.groupBy("repo_id", component.alias("source"), F.col("rule_id").alias("target")).agg(F.count("*").alias("weight")),
    }


def save_run(findings: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Appends a run's five tables by repository, and gives them as they were read back."""
    out = {}
    for name, rows in snapshot_tables(findings).items():
        rows.write.mode("append").partitionBy("repo_id").parquet(f"{folder}/{name}")
        out[name] = findings.sparkSession.read.parquet(f"{folder}/{name}")
    return out


def document(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(value): the lines of a report of all findings, written as one document and read back."""
    path = f"{Scratch(spark, kind).folder}/report.{kind}"
    report.write(view(spark, sf_dir, "findings"), kind, path)
    return spark.read.text(path)


def _registered() -> None:
    """Queries that write documents and give what they hold, read back line by line."""
    fail = "severity IN ('CRITICAL', 'HIGH')"
    level = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
    esc = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    place = "concat(file_path, ':', CAST(line AS VARCHAR))"
    ordered_sql = "ORDER BY file_path, line, coalesce(col, 0), rule_id, input_pos"
    result = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>"

    def sarif(s: SparkSession, d: str) -> DataFrame:
        rows = document(s, d, "sarif").where("value like '{\"ruleId\"%'").select(F.from_json(F.rtrim("value", F.lit(",")), result).alias("r"))
        at = F.col("r.locations")[0]["physicalLocation"]
        return rows.select(F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("snippet"), at["artifactLocation"]["uri"].alias("file_path"), at["region"]["startLine"].alias("line"))

    def junit(s: SparkSession, d: str) -> DataFrame:
        lines = document(s, d, "junit").where("value like '<testcase%'")
        return lines.select(F.regexp_extract("value", 'name="([^"]*)"', 1).alias("name"), F.col("value").contains("<failure").alias("failed"))

    def excel(s: SparkSession, d: str) -> DataFrame:
        path = f"{Scratch(s, 'excel').folder}/report.excel"
        report.write(view(s, d, "findings"), "excel", path)
        rows = report.sheet_lines(s, path).where("value like '<row r=%' and value not like '<row r=''1''>%'")
        cells = F.regexp_extract_all("value", F.lit("<t xml:space='preserve'>([^<]*)</t>"), 1)
        # a table goes on in sheets of its name and a number
        return rows.select(F.regexp_replace("sheet", r" \d+$", "").alias("sheet"), F.array_join(cells, "|").alias("cells"))

    def pdf(s: SparkSession, d: str) -> DataFrame:
        return document(s, d, "pdf").where("value like '(%) Tj T*'").select(F.regexp_extract("value", r"^\((.*)\) Tj T\*$", 1).alias("line"))

    one = {
        "k_02_sarif_document": (f"SELECT rule_id, {level} AS level, snippet, file_path, line FROM {{findings}}", sarif),
        "k_03_html": (f"SELECT concat('<tr><td>', {esc.format(x='severity')}, '</td><td>', {esc.format(x='rule_id')}, '</td><td>', {esc.format(x='file_path')}, ':', CAST(line AS VARCHAR), '</td></tr>') AS value FROM {{findings}}", lambda s, d: document(s, d, "html").where("value like '<tr>%'")),
        "k_04_markdown": ("SELECT concat('| ', severity, ' | ', rule_id, ' | ', file_path, ':', CAST(line AS VARCHAR), ' |') AS line FROM (SELECT * FROM {findings} " + ordered_sql + " LIMIT 25) t", lambda s, d: s.createDataFrame([(x,) for x in markdown(view(s, d, "findings")).splitlines()[2:]], "line string")),
        "k_05_junit": (f"SELECT concat(rule_id, ' ', {place}) AS name, {fail} AS failed FROM {{findings}}", junit),
        "k_08_excel": ("SELECT 'Summary' AS sheet, concat(severity, '|', category, '|', CAST(count(*) AS VARCHAR)) AS cells FROM {findings} GROUP BY severity, category UNION ALL SELECT 'Findings', concat(severity, '|', rule_id, '|', file_path, '|', CAST(line AS VARCHAR)) FROM {findings} UNION ALL SELECT 'By rule', concat(rule_id, '|', severity, '|', CAST(count(*) AS VARCHAR)) FROM {findings} GROUP BY rule_id, severity UNION ALL SELECT 'By file', concat(file_path, '|', CAST(count(*) AS VARCHAR)) FROM {findings} GROUP BY file_path UNION ALL SELECT 'Remediation', concat(rule_id, '|', CAST(count(*) AS VARCHAR), '|', CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CWE.items()) + " ELSE '' END) FROM {findings} GROUP BY rule_id", excel),
        "k_09_pdf": (f"SELECT concat(severity, repeat(' ', 9 - length(severity)), ' ', rule_id, repeat(' ', 12 - length(rule_id)), ' ', {place}) AS line FROM {{findings}}", pdf),
        "k_11_snapshot_tables": ("SELECT repo_id, count(*) AS total, CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical, count(DISTINCT rule_id) AS rules, count(DISTINCT file_path) AS files FROM {findings} GROUP BY repo_id", _saved_run),
        "k_14_audit_log": ("SELECT conv_id, count(*) AS events, CAST(sum(turn) AS BIGINT) AS turns FROM {turns} GROUP BY conv_id", _saved_log),
    }
    for name, (sql, run) in one.items():
        native(name, "turns" if name == "k_14_audit_log" else "findings", sql=sql)(run)


def _saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = save_run(view(spark, sf_dir, "findings"), Scratch(spark, "run").folder)
    rules = tables["deductions"].groupBy("repo_id").agg(F.count("*").alias("rules"))
    files = tables["findings"].groupBy("repo_id").agg(F.countDistinct("file_path").alias("files"))
    return tables["snapshots"].select("repo_id", F.col("total_findings").alias("total"), F.col("critical_count").alias("critical")).join(rules, "repo_id").join(files, "repo_id").select("repo_id", "total", "critical", "rules", "files")


def _saved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "log").folder
    save_audit_log(view(spark, sf_dir, "turns"), folder)
    lines = spark.read.schema("conv_id long, role string, text string, turn long").json(folder)
    return lines.groupBy("conv_id").agg(F.count("*").alias("events"), F.sum("turn").alias("turns"))


_registered()
