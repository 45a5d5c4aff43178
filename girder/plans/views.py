"""Logical views: the audit engine's relations over the base tables, one SQL text for both engines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


@dataclass(frozen=True)
class View:
    inputs: tuple[str, ...]
    sql: str


def _view(*inputs: str, sql: str) -> View:
    return View(inputs, sql.strip())


VIEWS: dict[str, View] = {
    # findings of an audit: a row an event
    "findings": _view(
        "events",
        sql="""
SELECT event_id AS input_pos, concat('F', CAST(event_id AS STRING)) AS id, event_type AS rule_id, concat('user/', CAST(user_id AS STRING)) AS file_path,
       concat('repo', CAST(user_id % 7 AS STRING)) AS repo_id, CAST(event_id % 50 + 1 AS INT) AS line, CAST(event_id % 7 AS INT) AS col,
       CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'HIGH' WHEN value > 20 THEN 'MEDIUM' WHEN value > 5 THEN 'LOW' ELSE 'INFO' END AS severity,
       CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
       CASE WHEN event_type IN ('error', 'purchase') THEN 'SECURITY' ELSE 'ARCHITECTURE' END AS category,
       CASE WHEN event_id % 2 = 0 THEN 'DETERMINISTIC' ELSE 'HEURISTIC' END AS evidence_type,
       concat('k', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS STRING)) AS snippet,
       value, user_id, CAST(CAST(ts AS DATE) AS STRING) AS day
FROM {events}""",
    ),
    # two runs of one code base: rows dropped, added, moved, edited
    "current_findings": _view("findings", sql="SELECT input_pos, id, rule_id, file_path, line, col, severity, category, snippet FROM {findings} WHERE input_pos % 10 <> 0"),
    "baseline_findings": _view(
        "findings",
        sql="""
SELECT input_pos, CASE WHEN input_pos % 4 = 0 THEN concat('B', CAST(input_pos AS STRING)) ELSE id END AS id, rule_id, file_path,
       CASE WHEN input_pos % 6 = 0 THEN line + 1 ELSE line END AS line, col, severity, category,
       CASE WHEN input_pos % 9 = 0 THEN 'edited' ELSE snippet END AS snippet
FROM {findings} WHERE input_pos % 10 <> 1""",
    ),
    # snapshots: a day each
    "snapshots": _view("findings", sql="SELECT day AS snapshot, CAST(dense_rank() OVER (ORDER BY day) AS INT) AS seq FROM (SELECT DISTINCT day FROM {findings}) d"),
    "snapshot_keys": _view(
        "findings",
        "snapshots",
        sql="""
SELECT DISTINCT s.seq, s.snapshot, CASE WHEN f.snippet <> '' THEN concat_ws('::', f.rule_id, lower(f.file_path), f.snippet) ELSE concat_ws('::', f.rule_id, lower(f.file_path), CAST(f.line AS STRING)) END AS key
FROM {findings} f JOIN {snapshots} s ON f.day = s.snapshot""",
    ),
    # modules are parts, in packages of twenty. The first and second part of an order make an import within the package, the next pair, if small, one
    # by the package's first module; a returned third part imports its successor in an earlier package. Nothing is left out of the graph that the rule makes.
    "modules": _view(
        "part",
        sql="""
SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, concat('src/', CASE p_partkey % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'services' WHEN 2 THEN 'domain' WHEN 3 THEN 'db' WHEN 4 THEN 'utils' ELSE 'misc' END, '/', replace(p_name, ' ', '_'), CAST(p_partkey AS STRING), '.py') AS path,
       CAST(floor(p_partkey / 20) AS BIGINT) AS component, CAST(p_size * 97 % 1200 AS BIGINT) AS loc
FROM {part}""",
    ),
    "edges": _view(
        "lineitem",
        "modules",
        sql="""
SELECT src, tgt, count(*) AS n FROM (
  SELECT CASE WHEN a.l_linenumber = 2 THEN a.l_partkey - a.l_partkey % 20 ELSE a.l_partkey END AS src,
         CASE WHEN a.l_linenumber = 3 THEN b.l_partkey ELSE a.l_partkey - a.l_partkey % 20 + b.l_partkey % 20 END AS tgt
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE (a.l_linenumber = 1 AND a.l_returnflag <> 'N') OR (a.l_linenumber = 2 AND a.l_quantity <= 25)
     OR (a.l_linenumber = 3 AND a.l_returnflag = 'R' AND a.l_linestatus = 'F' AND floor(a.l_partkey / 20) > floor(b.l_partkey / 20))) x
JOIN {modules} m ON m.id = x.tgt WHERE src <> tgt GROUP BY src, tgt""",
    ),
    "component_edges": _view(
        "edges",
        "modules",
        sql="""
SELECT a.component AS src, b.component AS tgt, CAST(count(*) AS BIGINT) AS weight
FROM {edges} e JOIN {modules} a ON a.id = e.src JOIN {modules} b ON b.id = e.tgt WHERE a.component <> b.component GROUP BY a.component, b.component""",
    ),
    # imports between packages go to earlier ones only, as dependencies between the repositories of a workspace do
    "repositories": _view("modules", sql="SELECT DISTINCT component AS id FROM {modules}"),
    "repo_dag": _view("component_edges", sql="SELECT src AS repo, tgt AS needs FROM {component_edges}"),
    # repositories of a fleet
    "fleet": _view(
        "supplier",
        "nation",
        sql="""
SELECT s_suppkey AS repo_id, n_nationkey AS workspace, n_regionkey AS organisation,
       CASE WHEN s_acctbal > 8000 THEN 'CRITICAL' WHEN s_acctbal > 5000 THEN 'HIGH' WHEN s_acctbal > 2000 THEN 'MEDIUM' WHEN s_acctbal > 0 THEN 'LOW' ELSE 'INFO' END AS criticality,
       CAST(s_suppkey * 37 % 101 AS DOUBLE) AS health
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    ),
    "texts": _view("documents", sql="SELECT doc_id, source, lang, text FROM {documents}"),
    "turns": _view("conversations", sql="SELECT conv_id, turn, role, text FROM {conversations}"),
    "orders_v": _view("orders", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders}"),
    "pages_v": _view("pages", sql="SELECT page_id, url, html FROM {pages}"),
    "files": _view(
        "part",
        sql="""
SELECT p_partkey AS pos, concat(CASE p_partkey % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'My-App/core/' WHEN 4 THEN '' ELSE 'pkg/Sub-Dir/deep/' END, replace(p_name, ' ', '_'), CAST(p_partkey AS STRING),
              CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.min.js' WHEN 3 THEN '.go' ELSE '.pb.py' END) AS path,
       CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'go' ELSE 'python' END AS language,
       CAST(p_size * 97 % 1200 AS BIGINT) AS loc, CAST(floor(p_retailprice) AS BIGINT) AS size_bytes, sha_content AS content_hash
FROM (SELECT *, md5(concat(p_name, p_brand)) AS sha_content FROM {part}) p""",
    ),
    "old_files": _view(
        "files",
        sql="""
SELECT pos, CASE WHEN pos % 11 = 0 THEN concat('old/', path) ELSE path END AS path, language, size_bytes,
       CASE WHEN pos % 7 = 0 THEN md5(concat(content_hash, 'v0')) ELSE content_hash END AS content_hash
FROM {files} WHERE pos % 13 <> 0""",
    ),
    "new_files": _view("files", sql="SELECT pos, path, language, size_bytes, content_hash FROM {files} WHERE pos % 17 <> 0"),
    # calls between functions: parts ordered together
    "functions": _view("part", sql="SELECT p_partkey AS fn, concat(p_brand, '.', replace(p_name, ' ', '_')) AS qualified_name, CAST(p_partkey % 40 AS INT) AS file_id, CAST(floor(p_partkey / 40) * 10 AS INT) AS line_start, CAST(floor(p_partkey / 40) * 10 + p_size AS INT) AS line_end FROM {part}"),
    "calls": _view(
        "lineitem",
        sql="""
SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee, CAST(a.l_linenumber % 2 AS INT) AS from_param, CAST(b.l_linenumber % 2 AS INT) AS to_param
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, as a lazy DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    v = VIEWS[name]
    return spark.sql(v.sql, **{x: view(spark, sf_dir, x) for x in v.inputs})


def tables_of(name: str) -> set[str]:
    """The base tables below a view."""
    return {name} if name not in VIEWS else set().union(*map(tables_of, VIEWS[name].inputs))
