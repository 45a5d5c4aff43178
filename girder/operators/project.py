"""Operators over manifests, configurations and caches: loading, scoped invalidation, reuse, equivalence, features, terminal reports."""

from __future__ import annotations

import gzip
import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from girder.operators import summaries
from girder.operators.findings import rank
from girder.operators.graph import closure
from girder.operators.matching import j_16, j_20
from girder.plans.operator import Dialect, native, operator, view
from girder.plans.ordered import placed
from girder.plans.scratch import Scratch
from girder.sources import project
from girder.sources.cache import Cache, envelope

# configuration and workspace

CONFIG = "version: 1\nanalysis:\n  max_call_depth: 7   # deeper\n  disabled_rules: [ARC-002, SEC-JS-006]\n  fail_on: high\npaths:\n  exclude:\n    - node_modules\n    - 'dist'\n"


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame([(k, scope, json.dumps(config[k])) for k, scope, *_ in project.PARAMETERS], "name string, scope string, value string")


@native("s_10_configuration", sql="SELECT * FROM (VALUES ('max_call_depth', '9'), ('disabled_rules', '[\"ARC-002\", \"SEC-JS-006\"]'), ('fail_on', '\"HIGH\"'), ('exclude', '[\"node_modules\", \"dist\"]'), ('max_k', '2')) v(name, value)")
def s_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by precedence: given, then the file's, then the default."""
    rows = config_rows(spark, project.configuration(CONFIG, {"max_call_depth": 9}))
    return rows.where("name in ('max_call_depth', 'disabled_rules', 'fail_on', 'exclude', 'max_k')").select("name", "value")


@native("i_02_scoped_digests", sql="SELECT * FROM (VALUES ('callgraph'), ('paths'), ('rules'), ('gate')) v(scope)")
def i_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes whose digest differs between two configurations: only what depends on them is computed anew."""
    a, b = (project.scoped_digests(project.configuration(t)) for t in ("", CONFIG))
    return spark.createDataFrame([(k,) for k in a if a[k] != b[k]], "scope string")


@native("a_31_digests", sql="SELECT 13 AS scopes, 64 AS length, true AS stable")
def a_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests don't depend on the order of keys; a scope each."""
    once, again = (project.scoped_digests(dict(x)) for x in (project.configuration(CONFIG).items(), reversed(project.configuration(CONFIG).items())))
    return spark.createDataFrame([(len(once), len(next(iter(once.values()))), once == again)], "scopes int, length int, stable boolean")


@native("s_11_workspace", "fleet", sql="SELECT workspace, count(*) AS members, CAST(sum(CASE WHEN repo_id > lo THEN 1 ELSE 0 END) AS BIGINT) AS depending FROM (SELECT workspace, repo_id, min(repo_id) OVER (PARTITION BY workspace) AS lo FROM {fleet}) f GROUP BY workspace")
def s_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest a workspace, written from the fleet and read back; each member depends on its workspace's first."""
    f = view(spark, sf_dir, "fleet").withColumn("lo", F.min("repo_id").over(W.partitionBy("workspace")))
    one = F.concat(F.lit("  - id: r"), "repo_id", F.lit("\n    path: ./r"), "repo_id", F.lit("\n    criticality: "), "criticality", F.when(F.col("repo_id") > F.col("lo"), F.concat(F.lit("\n    depends_on: [r"), "lo", F.lit("]"))).otherwise(""), F.lit("\n"))
    texts = f.groupBy("workspace").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("members"))
    texts = texts.select("workspace", F.concat(F.lit("workspace_id: w"), "workspace", F.lit("\nname: 'W "), "workspace", F.lit("'\nrepositories:\n"), "members").alias("text"))

    def read(batches):
        for b in batches:
            held = [project.workspace(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w.repositories) for w in held], pa.int64()), pa.array([sum(bool(m.depends_on) for m in w.repositories) for w in held], pa.int64())], ["workspace", "members", "depending"])

    return texts.mapInArrow(read, f"workspace {f.schema['workspace'].dataType.simpleString()}, members long, depending long")


@native("g_13_pack_inheritance", sql="SELECT * FROM (VALUES (0, 'base'), (1, 'security'), (2, 'web'), (3, 'strict')) v(place, pack)")
def g_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs in the order in which their rules are merged."""
    order = project.pack_order({"base": [], "security": ["base"], "web": ["base"], "strict": ["security", "web"]}, "strict")
    return spark.createDataFrame(list(enumerate(order)), "place int, pack string")


@native("s_12_baseline", "baseline_findings", sql="SELECT rule_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM {baseline_findings} GROUP BY rule_id")
def s_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result is saved as one document and read back as the rows that comparison takes."""
    path = f"{Scratch(spark, 'baseline').folder}/baseline.json"
    project.save_baseline(view(spark, sf_dir, "baseline_findings"), path)
    return project.baseline(spark, path).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


# caches

#: What each layer's key is made of besides the namespace.
LAYERS = {1: ("path",), 2: ("composite", "'parsing'"), 3: ("repo_hash", "'dependency'"), 4: ("function", "content_hash", "'dataflow'"), 5: ("function", "l4", "'dataflow'"), 6: ("repo_hash", "'callgraph'"), 7: ("function", "content_hash", "'contract'"), 8: ("content_hash", "composite", "'composition'"), 9: ("findings_hash", "'rules'"), 10: ("content_hash", "composite", "path", "'1'", "'model'", "'provider'")}


@operator("p_10_cache_keys", "files")
def p_10(d: Dialect) -> str:
    """Keys of the ten layers: hashes of colon-joined parts after the layer's name and the namespace."""
    composite = d.sha("concat_ws(':', path, content_hash, language, '1', '1', CASE WHEN path LIKE '%.pb.py' THEN 'true' ELSE 'false' END)")
    base = f"SELECT pos, path, content_hash, concat('f', CAST(pos AS STRING)) AS function, substr({d.sha("concat('path:/', language)")}, 1, 16) AS ns, {composite} AS composite, {d.sha("concat('repo', language)")} AS repo_hash, {d.sha("concat('findings', CAST(pos AS STRING))")} AS findings_hash FROM {{files}}"
    key = lambda i: d.sha(f"concat_ws(':', 'L{i}', ns, {', '.join(LAYERS[i])})")
    return f"SELECT pos, ns, {', '.join(f'{key(i)} AS l{i}' for i in LAYERS if i != 4)}, l4 FROM (SELECT *, {key(4)} AS l4 FROM ({base}) b) k"


def evicted(rows: DataFrame, most_bytes: int, most_entries: int) -> DataFrame:
    """Entries (key, layer, written, size) that a cache of that size gives up, oldest first.

    The border is found by sums over hours, so that only the entries of one hour are put in order.
    """
    hour = F.date_trunc("hour", "written")
    hours = rows.groupBy(hour.alias("hour")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    newer = W.orderBy(F.col("hour").desc()).rowsBetween(W.unboundedPreceding, -1)  # a row an hour
    hours = hours.select("hour", F.coalesce(F.sum("bytes").over(newer), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("ahead"), "bytes", "n")
    joined = rows.withColumn("hour", hour).join(hours, "hour")
    whole = joined.where((F.col("before") >= most_bytes) | (F.col("ahead") >= most_entries))
    border = joined.where((F.col("before") < most_bytes) & (F.col("ahead") < most_entries) & ((F.col("before") + F.col("bytes") > most_bytes) | (F.col("ahead") + F.col("n") > most_entries)))
    order = W.partitionBy("hour").orderBy(F.col("written").desc(), "layer", "key").rowsBetween(W.unboundedPreceding, 0)
    border = border.withColumn("__b", F.col("before") + F.sum("size").over(order)).withColumn("__n", F.col("ahead") + F.row_number().over(W.partitionBy("hour").orderBy(F.col("written").desc(), "layer", "key")))
    border = border.where((F.col("__b") > most_bytes) | (F.col("__n") > most_entries))
    return whole.select(*rows.columns).union(border.select(*rows.columns))


def _entries(files: DataFrame) -> DataFrame:
    return files.select(F.sha2(F.concat_ws(":", F.lit("L1"), "path"), 256).alias("key"), F.to_json(F.struct("path", "content_hash", "size_bytes")).alias("payload"), "pos")


@native("s_13_cache_read", "files", sql="SELECT sha256(concat('L1:', path)) AS key, size_bytes FROM {files} WHERE NOT regexp_matches(path, '(^|[^0-9])[0-9]*0[.]')")
def s_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written, some of them damaged, and read back: the damaged ones are misses."""
    cache = Cache(spark, Scratch(spark, "cache").folder)
    rows = envelope(_entries(view(spark, sf_dir, "files")))
    cache.add("L1", rows.withColumn("payload", F.when(F.get_json_object("payload", "$.path").rlike("(^|[^0-9])[0-9]*0[.]"), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))
    return cache.get("L1").select("key", F.get_json_object("payload", "$.size_bytes").cast("long").alias("size_bytes"))


@native("k_13_cache_write", "files", sql="SELECT count(*) AS entries, count(DISTINCT path) AS files, CAST(sum(size_bytes + CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bytes FROM {files}")
def k_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write of some entries replaces them for readers, also after compaction."""
    cache = Cache(spark, Scratch(spark, "cache").folder)
    files = view(spark, sf_dir, "files")
    cache.put("L1", _entries(files))
    cache.put("L1", _entries(files.where("pos % 5 = 0").withColumn("size_bytes", F.col("size_bytes") + 1)))
    cache.compact("L1")
    got = cache.get("L1")
    return got.agg(F.count("*").alias("entries"), F.countDistinct(F.get_json_object("payload", "$.path")).alias("files"), F.sum(F.get_json_object("payload", "$.size_bytes").cast("long")).alias("bytes"))


@native("i_08_cache_eviction", "files", sql="SELECT path FROM (SELECT path, sum(size_bytes) OVER (ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, row_number() OVER (ORDER BY pos DESC) AS n FROM {files}) s WHERE total > 100000 OR n > 150")
def i_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest entries beyond the limits of size and number."""
    rows = view(spark, sf_dir, "files").select(F.col("path").alias("key"), F.lit("L1").alias("layer"), F.timestamp_seconds(F.col("pos") * 60).alias("written"), F.col("size_bytes").alias("size"))
    return evicted(rows, 100_000, 150).select(F.col("key").alias("path"))


# incremental runs


@native("i_04_short_circuit", "old_files", "new_files", sql="SELECT 'same' AS run, true AS reused UNION ALL SELECT 'changed', NOT EXISTS (SELECT 1 FROM {old_files} o FULL OUTER JOIN {new_files} n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.content_hash <> n.content_hash) UNION ALL SELECT 'settings', false")
def i_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result is taken again when no file and no setting differs."""
    old, new = view(spark, sf_dir, "old_files"), view(spark, sf_dir, "new_files")

    def reusable(a: DataFrame, b: DataFrame, x: dict, y: dict) -> bool:
        return project.scoped_digests(x) == project.scoped_digests(y) and not j_16(spark, old_files=a, new_files=b).take(1)

    plain, other = project.configuration(), project.configuration(CONFIG)
    return spark.createDataFrame([("same", reusable(new, new, plain, plain)), ("changed", reusable(old, new, plain, plain)), ("settings", reusable(new, new, plain, other))], "run string, reused boolean")


_CHANGED = "SELECT n.pos % 40 AS file_id FROM {new_files} n LEFT JOIN {old_files} o ON o.path = n.path WHERE o.path IS NULL OR o.content_hash <> n.content_hash"


def invalid_summaries(calls: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_id): files whose summaries no longer hold, since a file of a function that they call changed."""
    of = functions.select("fn", "file_id").distinct()
    edges = calls.select("caller", "callee").distinct().join(of.withColumnRenamed("fn", "caller"), "caller").withColumnRenamed("file_id", "file")
    edges = edges.join(of.select(F.col("fn").alias("callee"), F.col("file_id").alias("needs")), "callee").select("file", "needs").distinct()
    return edges.join(changed.select(F.col("file_id").alias("needs")).distinct(), "needs", "left_semi").select(F.col("file").alias("file_id")).distinct()


@native("t_21_summary_validity", "calls", "functions", "old_files", "new_files", sql=f"SELECT f.file_id, CASE WHEN max(CASE WHEN g.file_id IN ({_CHANGED}) THEN 1 ELSE 0 END) = 1 THEN 'INVALID' ELSE 'VALID' END AS state FROM {{functions}} f LEFT JOIN {{calls}} c ON c.caller = f.fn LEFT JOIN {{functions}} g ON g.fn = c.callee GROUP BY f.file_id")
def t_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's summary holds while no file that it calls into changed its hash."""
    functions = view(spark, sf_dir, "functions")
    bad = invalid_summaries(view(spark, sf_dir, "calls"), functions, _changed(spark, sf_dir)).withColumn("bad", F.lit(True))
    return functions.select("file_id").distinct().join(bad, "file_id", "left").select("file_id", F.when(F.col("bad"), "INVALID").otherwise("VALID").alias("state"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = j_16(spark, old_files=view(spark, sf_dir, "old_files"), new_files=view(spark, sf_dir, "new_files")).where("change <> 'DELETED'").select("path")
    return view(spark, sf_dir, "new_files").join(diff, "path", "left_semi").select((F.col("pos") % 40).cast("int").alias("file_id")).distinct()


@native("i_05_escalation", "calls", "functions", "old_files", "new_files", sql=f"WITH RECURSIVE e AS (SELECT DISTINCT f.file_id AS a, g.file_id AS b FROM {{calls}} c JOIN {{functions}} f ON f.fn = c.caller JOIN {{functions}} g ON g.fn = c.callee), r AS (SELECT DISTINCT CAST(file_id AS INTEGER) AS file_id FROM ({_CHANGED}) x UNION SELECT e.a FROM r JOIN e ON e.b = r.file_id) SELECT file_id FROM r")
def i_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to analyse again: the changed ones, and all that call into them, however far."""
    functions, changed = view(spark, sf_dir, "functions").select("fn", "file_id"), _changed(spark, sf_dir)
    e = view(spark, sf_dir, "calls").join(functions.select(F.col("fn").alias("caller"), F.col("file_id").alias("b")), "caller").join(functions.select(F.col("fn").alias("callee"), F.col("file_id").alias("a")), "callee")
    far = closure(e.select("a", "b"), changed.select(F.col("file_id").alias("a")), "escalation").select(F.col("b").alias("file_id"))
    return changed.select("file_id").union(far).distinct()


@operator("i_07_equivalence", "current_findings", "baseline_findings")
def i_07(d: Dialect) -> str:
    """An incremental run against a full one: how findings compare, and metrics beside each other."""
    metric = lambda name, x: f"SELECT '{name}' AS what, (SELECT {x} FROM {{current_findings}}) AS now, (SELECT {x} FROM {{baseline_findings}}) AS before"
    sums = " UNION ALL ".join(metric(n, f"CAST({x} AS BIGINT)") for n, x in (("findings", "count(*)"), ("files", "count(DISTINCT file_path)"), ("severity", f"sum({rank('severity')})")))
    return f"SELECT what, now, before, now = before AS equal FROM ({sums}) m UNION ALL SELECT state, count(*), CAST(0 AS BIGINT), state = 'SAME' FROM ({j_20.text(d)}) s GROUP BY state"


_AFFECTED = "SELECT file_path FROM {file_versions} WHERE old_hash <> new_hash"


@operator("u_05_reusable", "findings", "file_versions")
def u_05(d: Dialect) -> str:
    """Files of the last run that no change affects."""
    return f"SELECT DISTINCT file_path FROM {{findings}} EXCEPT {_AFFECTED}"


@operator("u_06_reconcile", "current_findings", "baseline_findings", "file_versions")
def u_06(d: Dialect) -> str:
    """Findings of unaffected files stay, those of affected files come from the new run; each once, the new one first."""
    anti, semi = ("ANTI JOIN", "SEMI JOIN") if d.name == "duckdb" else ("LEFT ANTI JOIN", "LEFT SEMI JOIN")
    key = "rule_id, file_path, line, coalesce(col, 0), snippet"
    return f"""
SELECT input_pos, rule_id, file_path, line, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pref, input_pos) AS k FROM (
    SELECT input_pos, rule_id, file_path, line, col, snippet, 1 AS pref, 'REUSED' AS origin FROM {{baseline_findings}} b {anti} ({_AFFECTED}) a ON a.file_path = b.file_path
    UNION ALL SELECT input_pos, rule_id, file_path, line, col, snippet, 0 AS pref, 'RECOMPUTED' AS origin FROM {{current_findings}} c {semi} ({_AFFECTED}) a ON a.file_path = c.file_path) u) r
WHERE k = 1"""


# budgets, priorities


#: Functions a file and in all, calls, and paths between functions that a run keeps.
FUNCTIONS_A_FILE, FUNCTIONS, CALLS, PATHS = 200, 5_000, 20_000, 50


def budgets(functions: DataFrame, calls: DataFrame, paths: DataFrame, limits: tuple[int, int, int, int] = (FUNCTIONS_A_FILE, FUNCTIONS, CALLS, PATHS)) -> DataFrame:
    """(budget, file_id, kept, beyond): limits within limits, each in one order over all tasks; what lies beyond is counted, not lost from sight.

    Functions go by line within their file, those kept go by file in all; calls count between kept functions, and paths from kept ones.
    """
    a_file, in_all, most_calls, most_paths = limits
    scratch = Scratch(functions.sparkSession, "budgets")
    by_file = scratch.save(placed(functions, scratch, "file", ["line_start", "fn"], ["file_id"]), "by-file")
    places = scratch.save(placed(by_file.where(F.col("place") < a_file).drop("place"), scratch, "all", ["file_id", "line_start", "fn"]), "in-all")
    kept = scratch.save(places.where(F.col("place") < in_all).select("fn"), "kept")
    of = lambda df, *ends: [df := df.join(kept.withColumnRenamed("fn", c), c, "left_semi") for c in ends][-1]
    edges = placed(of(calls, "caller", "callee"), scratch, "calls", ["caller", "callee", "from_param", "to_param"])
    ways = placed(of(paths, "source_fn"), scratch, "paths", ["source_fn", "callee", "category"])

    def counted(df: DataFrame, name: str, most: int, *by: str) -> DataFrame:
        n = df.groupBy(*by).agg(F.count_if(F.col("place") < most).alias("kept"), F.count_if(F.col("place") >= most).alias("beyond"))
        return n.select(F.lit(name).alias("budget"), (F.col(by[0]) if by else F.lit(None)).cast("int").alias("file_id"), "kept", "beyond")

    return counted(by_file, "functions of a file", a_file, "file_id").union(counted(places, "functions", in_all)).union(counted(edges, "calls", most_calls)).union(counted(ways, "paths", most_paths))


def _budget_sql() -> str:
    return f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_start, fn) AS k FROM {{functions}}),
g AS (SELECT *, row_number() OVER (ORDER BY file_id, line_start, fn) AS n FROM f WHERE k <= {FUNCTIONS_A_FILE}), h AS (SELECT fn FROM g WHERE n <= {FUNCTIONS}),
c AS (SELECT row_number() OVER (ORDER BY caller, callee, from_param, to_param) AS n FROM {{calls}} WHERE caller IN (SELECT fn FROM h) AND callee IN (SELECT fn FROM h)),
p AS (SELECT row_number() OVER (ORDER BY source_fn, callee, category) AS n FROM ({summaries._PATHS}) x WHERE source_fn IN (SELECT fn FROM h))
SELECT 'functions of a file' AS budget, file_id, count(*) FILTER (k <= {FUNCTIONS_A_FILE}) AS kept, count(*) FILTER (k > {FUNCTIONS_A_FILE}) AS beyond FROM f GROUP BY file_id
UNION ALL SELECT 'functions', NULL, count(*) FILTER (n <= {FUNCTIONS}), count(*) FILTER (n > {FUNCTIONS}) FROM g UNION ALL SELECT 'calls', NULL, count(*) FILTER (n <= {CALLS}), count(*) FILTER (n > {CALLS}) FROM c
UNION ALL SELECT 'paths', NULL, count(*) FILTER (n <= {PATHS}), count(*) FILTER (n > {PATHS}) FROM p"""


@native("o_09_bounded_budgets", "functions", "calls", "own_flows", "call_flows", "source_calls", sql=_budget_sql())
def o_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets(view(spark, sf_dir, "functions"), view(spark, sf_dir, "calls"), summaries.nearest(spark, sf_dir))


@operator("l_05_prioritise", "findings", "audit_findings")
def l_05(d: Dialect) -> str:
    """Exploitability from the finding's factors, priority from it, a rationale in words, and a hash of what it rests on."""
    surface = "CASE WHEN a.sink = '' THEN 0.5 WHEN a.has_auth THEN 0.2 ELSE 1.0 END"
    auth, authz = "CASE WHEN a.has_auth THEN 0.2 ELSE 1.0 END", "CASE WHEN a.has_authz THEN 0.25 ELSE 1.0 END"
    form, path = "CASE WHEN a.sanitizer = '' THEN 1.0 ELSE 0.3 END", "CASE WHEN a.value_type = '' THEN 1.0 ELSE 0.7 END"
    exploit = f"round(CAST(0.25 AS DOUBLE) * CAST({surface} AS DOUBLE) + CAST(0.20 AS DOUBLE) * CAST({auth} AS DOUBLE) + CAST(0.15 AS DOUBLE) * CAST({authz} AS DOUBLE) + CAST(0.20 AS DOUBLE) * CAST({form} AS DOUBLE) + CAST(0.20 AS DOUBLE) * CAST({path} AS DOUBLE), 4)"
    base = "CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END + CASE confidence WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 12 ELSE 5 END"
    return f"""
SELECT id, exploitability, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band, concat(severity, ' finding of ', rule_id, CASE WHEN exploitability >= 0.6 THEN ', easy to exploit' ELSE ', hard to exploit' END) AS rationale,
 {d.sha("concat_ws('|', rule_id, severity, confidence, sink)")} AS context_hash
FROM (SELECT *, round(least(100.0, greatest(0.0, {base} + 40.0 * exploitability)), 2) AS score FROM (SELECT f.id, f.severity, f.confidence, a.rule_id, a.sink, {exploit} AS exploitability FROM {{findings}} f JOIN {{audit_findings}} a ON a.id = f.id) x) y"""


#: Words of a policy in plain language, and the setting that they name.
SYNONYMS = (("sql", "sink", "SQL_EXECUTE"), ("database", "sink", "SQL_EXECUTE"), ("query", "sink", "SQL_EXECUTE"), ("shell", "sink", "COMMAND_EXECUTE"), ("command", "sink", "COMMAND_EXECUTE"), ("subprocess", "sink", "COMMAND_EXECUTE"), ("html", "sink", "DOM_INJECTION"), ("dom", "sink", "DOM_INJECTION"), ("xss", "sink", "DOM_INJECTION"), ("eval", "sink", "CODE_EVAL"), ("login", "require_auth", "true"), ("authenticated", "require_auth", "true"), ("authorized", "require_authz", "true"), ("permission", "require_authz", "true"), ("escape", "sanitizer", "html.escape"), ("quote", "sanitizer", "shlex.quote"), ("integer", "sanitizer", "int"))
VAGUE = ("secure", "safe", "proper", "properly", "good", "appropriate", "reasonable", "better")


def policy_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text's columns, setting, value): what a sentence asks for, by its words; nothing is guessed."""
    spark = texts.sparkSession
    words = texts.withColumn("word", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "))))
    known = spark.createDataFrame(list(SYNONYMS), "word string, setting string, value string")
    return words.join(F.broadcast(known), "word").drop("word", text).distinct()


_SAID = "SELECT CAST(o_orderkey AS BIGINT) AS id, concat('Every ', CASE o_orderkey % 4 WHEN 0 THEN 'SQL query' WHEN 1 THEN 'shell command' WHEN 2 THEN 'HTML output' ELSE 'page' END, CASE WHEN o_orderkey % 3 = 0 THEN ' needs a login' ELSE ' should be secure' END) AS text FROM {orders_v}"


@native("l_09_policy_fallback", "orders_v", sql="SELECT id, setting, value FROM (SELECT o_orderkey AS id, 'sink' AS setting, CASE o_orderkey % 4 WHEN 0 THEN 'SQL_EXECUTE' WHEN 1 THEN 'COMMAND_EXECUTE' WHEN 2 THEN 'DOM_INJECTION' END AS value FROM {orders_v} UNION ALL SELECT o_orderkey, 'require_auth', 'true' FROM {orders_v} WHERE o_orderkey % 3 = 0) x WHERE value IS NOT NULL")
def l_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in plain words become settings without a model."""
    return policy_words(spark.sql(_SAID, orders_v=view(spark, sf_dir, "orders_v")))


@native("p_31_policy_validation", "orders_v", sql="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'secure' END AS problem, o_orderkey % 4 = 3 AND o_orderkey % 3 <> 0 AS empty FROM {orders_v}")
def p_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vague words, and sentences that name nothing that a policy could ask for."""
    said = spark.sql(_SAID, orders_v=view(spark, sf_dir, "orders_v"))
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    vague = F.array_join(F.array_intersect(words, F.array(*map(F.lit, VAGUE))), ",")
    named = F.arrays_overlap(words, F.array(*[F.lit(w) for w, _, _ in SYNONYMS]))
    return said.select("id", F.when(vague == "", "ok").otherwise(vague).alias("problem"), (~named).alias("empty"))


# terminal


def terminal(findings: DataFrame, n: int = 20, colour: bool = False) -> str:
    """The first findings by severity, and counts of all of them, as text for a terminal."""
    shades = {"CRITICAL": "35", "HIGH": "31", "MEDIUM": "33", "LOW": "36", "INFO": "37"}
    paint = lambda s, k: f"\033[{shades[k]}m{s}\033[0m" if colour else s
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    first = findings.orderBy(F.expr(rank("severity")).desc(), "file_path", "line", "rule_id", "input_pos").limit(n).collect()
    lines = [f"{sum(counts.values())} findings: " + ", ".join(f"{counts[k]} {k}" for k in shades if counts.get(k))]
    lines += [f"{paint(f'{r["severity"]:8}', r['severity'])} {r['rule_id']:12} {r['file_path']}:{r['line']}" for r in first]
    if sum(counts.values()) > len(first):
        lines.append(f"and {sum(counts.values()) - len(first)} more")
    return "\n".join(lines) + "\n"


def _head(n: int) -> str:
    return f"SELECT concat(rpad(severity, 8, ' '), ' ', rpad(rule_id, 12, ' '), ' ', file_path, ':', CAST(line AS VARCHAR)) AS line FROM (SELECT * FROM {{findings}} ORDER BY {rank('severity')} DESC, file_path, line, rule_id, input_pos LIMIT {n}) f"


@native("k_10_terminal", "findings", sql=_head(20))
def k_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = terminal(view(spark, sf_dir, "findings")).splitlines()[1:21]
    return spark.createDataFrame([(x,) for x in lines], "line string")


def packed(payload: str) -> bytes:
    """An entry's payload as it travels between machines: compressed, the same bytes each time."""
    return gzip.compress(payload.encode(), mtime=0)


def unpacked(data: bytes, checksum: str) -> str | None:
    """The payload, or None when it was damaged."""
    try:
        text = gzip.decompress(data).decode()
    except (OSError, EOFError, UnicodeDecodeError):
        return None
    return text if hashlib.sha256(text.encode()).hexdigest() == checksum else None
