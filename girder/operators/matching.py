"""Comparison of runs, manifests and histories: one-to-one matching, set differences, trends."""

from __future__ import annotations

from girder.operators.findings import rank
from girder.plans.operator import Dialect, operator

PATH = "lower(replace(file_path, chr(92), '/'))"


def baseline_diff(d: Dialect) -> str:
    """Staged one-to-one matching: by fingerprint, then by place, then by id; each stage works on what the earlier left over. A missing side is -1."""
    fp = f"concat_ws(':', rule_id, {PATH}, trim({d.sub('snippet', '[ ]+', ' ')}))"
    place = f"concat_ws(':', rule_id, {PATH}, CAST(coalesce(line, 1) AS STRING))"
    keys = (("fp", fp), ("place", place), ("id", "id"))
    anti = "ANTI JOIN" if d.name == "duckdb" else "LEFT ANTI JOIN"
    ctes, left, right = [], "{current_findings}", "{baseline_findings}"
    for i, (name, key) in enumerate(keys):
        for side, rel in (("c", left), ("b", right)):
            ctes.append(f"{side}{i} AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY input_pos) AS i FROM {rel})")
        ctes.append(f"m{i} AS (SELECT c.input_pos AS c_pos, b.input_pos AS b_pos, '{name}' AS tier, CASE WHEN '{name}' = 'place' THEN 'MODIFIED' WHEN '{name}' = 'id' OR c.line = b.line THEN 'UNCHANGED' ELSE 'MODIFIED' END AS transition, c.severity FROM c{i} c JOIN b{i} b ON c.k = b.k AND c.i = b.i)")
        cols = "input_pos, id, rule_id, file_path, line, col, severity, category, snippet"
        ctes.append(f"cl{i} AS (SELECT {cols} FROM c{i} c {anti} m{i} m ON c.input_pos = m.c_pos)")
        ctes.append(f"bl{i} AS (SELECT {cols} FROM b{i} b {anti} m{i} m ON b.input_pos = m.b_pos)")
        left, right = f"cl{i}", f"bl{i}"
    union = " UNION ALL ".join(f"SELECT c_pos, b_pos, tier, transition, severity FROM m{i}" for i in range(3))
    return f"""WITH {", ".join(ctes)}
{union}
UNION ALL SELECT input_pos, CAST(-1 AS BIGINT), 'none', 'NEW', severity FROM cl2
UNION ALL SELECT CAST(-1 AS BIGINT), input_pos, 'none', 'RESOLVED', severity FROM bl2"""


@operator("j_01_baseline_diff", "current_findings", "baseline_findings")
def j_01(d: Dialect) -> str:
    return baseline_diff(d)


@operator("a_11_diff_summary", "current_findings", "baseline_findings")
def a_11(d: Dialect) -> str:
    return f"SELECT transition, severity, count(*) AS n FROM ({baseline_diff(d)}) x GROUP BY transition, severity"


@operator("o_03_diff_order", "current_findings", "baseline_findings")
def o_03(d: Dialect) -> str:
    return f"SELECT c_pos, b_pos, transition FROM ({baseline_diff(d)}) x ORDER BY CASE transition WHEN 'NEW' THEN 0 WHEN 'MODIFIED' THEN 1 WHEN 'UNCHANGED' THEN 2 ELSE 3 END, c_pos, b_pos"


@operator("j_20_equivalence_match", "current_findings", "baseline_findings")
def j_20(d: Dialect) -> str:
    """By id, then one-to-one by (rule, path, snippet); the rest is missing or a phantom."""
    anti = "ANTI JOIN" if d.name == "duckdb" else "LEFT ANTI JOIN"
    key = f"concat_ws(':', rule_id, {PATH}, snippet)"
    return f"""
WITH a AS (SELECT c.input_pos AS c_pos, b.input_pos AS b_pos, CASE WHEN c.line = b.line THEN 'SAME' ELSE 'RELOCATED' END AS state FROM {{current_findings}} c JOIN {{baseline_findings}} b ON c.id = b.id),
c1 AS (SELECT input_pos, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY input_pos) AS i FROM {{current_findings}} c {anti} a ON c.input_pos = a.c_pos),
b1 AS (SELECT input_pos, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY input_pos) AS i FROM {{baseline_findings}} b {anti} a ON b.input_pos = a.b_pos)
SELECT c_pos, b_pos, state FROM a
UNION ALL SELECT coalesce(c1.input_pos, -1), coalesce(b1.input_pos, -1), CASE WHEN b1.k IS NULL THEN 'PHANTOM' WHEN c1.k IS NULL THEN 'MISSING' ELSE 'RELOCATED' END FROM c1 FULL OUTER JOIN b1 ON c1.k = b1.k AND c1.i = b1.i"""


@operator("j_16_manifest_diff", "old_files", "new_files")
def j_16(d: Dialect) -> str:
    """Full outer on path by hash; a rename is a (hash, size) held by one deleted path, given to its first added path."""
    return """
WITH x AS (
  SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'DELETED' WHEN o.content_hash <> n.content_hash THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change,
         coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.size_bytes, o.size_bytes) AS size_bytes
  FROM {old_files} o FULL OUTER JOIN {new_files} n ON o.path = n.path
), gone AS (
  SELECT content_hash, size_bytes, min(path) AS old_path FROM x WHERE change = 'DELETED' GROUP BY content_hash, size_bytes HAVING count(*) = 1
), moved AS (
  SELECT gone.old_path, min(x.path) AS new_path FROM x JOIN gone ON x.content_hash = gone.content_hash AND x.size_bytes = gone.size_bytes WHERE x.change = 'ADDED' GROUP BY gone.old_path
)
SELECT x.path, CASE WHEN a.new_path IS NOT NULL THEN 'RENAMED' ELSE x.change END AS change, a.old_path
FROM x LEFT JOIN moved a ON x.path = a.new_path AND x.change = 'ADDED' LEFT JOIN moved g ON x.path = g.old_path AND x.change = 'DELETED' WHERE g.old_path IS NULL AND x.change <> 'UNCHANGED'"""


@operator("i_01_fingerprint_manifest", "new_files")
def i_01(d: Dialect) -> str:
    return f"SELECT path, {d.sha("concat_ws(':', path, content_hash, language, '1', '1', CASE WHEN path LIKE '%.pb.py' THEN 'true' ELSE 'false' END)")} AS composite_hash FROM {{new_files}}"


@operator("p_22_function_change_kind", "functions")
def p_22(d: Dialect) -> str:
    return """
WITH o AS (SELECT fn, qualified_name, line_end - line_start AS body, fn % 3 AS arity FROM {functions} WHERE fn % 19 <> 0),
n AS (SELECT fn, qualified_name, line_end - line_start + CASE WHEN fn % 8 = 0 THEN 1 ELSE 0 END AS body, fn % 3 + CASE WHEN fn % 12 = 0 THEN 1 ELSE 0 END AS arity FROM {functions} WHERE fn % 23 <> 0)
SELECT coalesce(n.fn, o.fn) AS fn, CASE WHEN o.fn IS NULL THEN 'ADDED' WHEN n.fn IS NULL THEN 'REMOVED' WHEN o.arity <> n.arity THEN 'SIGNATURE' WHEN o.body <> n.body THEN 'BODY' ELSE 'NONE' END AS kind FROM o FULL OUTER JOIN n ON o.fn = n.fn"""


@operator("a_12_component_delta", "component_edges")
def a_12(d: Dialect) -> str:
    def inst(rel: str) -> str:
        return f"SELECT c, round(CAST(sum(e) AS DOUBLE) / (sum(a) + sum(e)), 4) AS i FROM (SELECT src AS c, 0 AS a, 1 AS e FROM {rel} UNION ALL SELECT tgt, 1, 0 FROM {rel}) u GROUP BY c"

    old, new = "(SELECT * FROM {component_edges} WHERE (src + tgt) % 5 <> 0) x", "(SELECT * FROM {component_edges} WHERE (src + tgt) % 7 <> 0) x"
    return f"SELECT coalesce(n.c, o.c) AS component, round(coalesce(n.i, 0.0) - coalesce(o.i, 0.0), 3) AS delta FROM ({inst(old)}) o FULL OUTER JOIN ({inst(new)}) n ON o.c = n.c WHERE abs(coalesce(n.i, 0.0) - coalesce(o.i, 0.0)) > 0.001"


@operator("u_02_set_difference", "current_findings", "baseline_findings")
def u_02(d: Dialect) -> str:
    return "SELECT DISTINCT rule_id, file_path, line FROM {current_findings} EXCEPT SELECT DISTINCT rule_id, file_path, line FROM {baseline_findings}"


@operator("u_03_intersection", "current_findings", "baseline_findings")
def u_03(d: Dialect) -> str:
    return "SELECT DISTINCT rule_id, file_path, line FROM {current_findings} INTERSECT SELECT DISTINCT rule_id, file_path, line FROM {baseline_findings}"


@operator("j_17_policy_diff", "current_findings", "baseline_findings")
def j_17(d: Dialect) -> str:
    def policies(rel: str) -> str:
        return f"SELECT concat(rule_id, ':', severity) AS policy_id, max(col) AS require_auth, min(line) AS version FROM {rel} GROUP BY concat(rule_id, ':', severity)"

    return f"""
SELECT coalesce(n.policy_id, o.policy_id) AS policy_id, CASE WHEN o.policy_id IS NULL THEN 'ADDED' WHEN n.policy_id IS NULL THEN 'REMOVED' WHEN o.require_auth < n.require_auth THEN 'TIGHTENED' WHEN o.require_auth > n.require_auth THEN 'RELAXED' WHEN o.version <> n.version THEN 'CHANGED' ELSE 'SAME' END AS change
FROM ({policies("{baseline_findings}")}) o FULL OUTER JOIN ({policies("{current_findings}")}) n ON o.policy_id = n.policy_id"""


@operator("a_21_invalidations_by_reason", "old_files", "new_files")
def a_21(d: Dialect) -> str:
    return f"SELECT change AS reason, count(*) AS n FROM ({j_16.text(d)}) x GROUP BY change"


@operator("a_22_incremental_stats", "old_files", "new_files")
def a_22(d: Dialect) -> str:
    return """
SELECT reused, reanalysed, round(CAST(reused AS DOUBLE) / (reused + reanalysed), 3) AS hit_ratio, round(0.05 * reused, 2) AS saved
FROM (SELECT CAST(sum(CASE WHEN o.content_hash = n.content_hash THEN 1 ELSE 0 END) AS DOUBLE) AS reused, CAST(sum(CASE WHEN o.content_hash = n.content_hash THEN 0 ELSE 1 END) AS DOUBLE) AS reanalysed FROM {new_files} n LEFT JOIN {old_files} o ON n.path = o.path) s"""


@operator("i_10_snapshot_cache", "orders_v")
def i_10(d: Dialect) -> str:
    return f"SELECT o_custkey, o_orderkey FROM {{orders_v}} WHERE o_orderstatus <> 'F' AND {d.days('CAST(o_orderdate AS DATE)', chr(39) + '1998-01-01' + chr(39) if d.name == 'spark' else 'DATE ' + chr(39) + '1998-01-01' + chr(39))} BETWEEN 0 AND 30"


# trends


def velocity() -> str:
    """New and resolved keys of each snapshot, by the gaps of each key's run of snapshots."""
    return """
WITH k AS (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS n FROM {snapshot_keys}),
top AS (SELECT max(seq) AS last_seq FROM {snapshots}),
e AS (SELECT seq, 1 AS born, 0 AS gone FROM k WHERE p IS NULL OR p < seq - 1
      UNION ALL SELECT k.seq + 1, 0, 1 FROM k CROSS JOIN top WHERE (k.n IS NULL OR k.n > k.seq + 1) AND k.seq < top.last_seq)
SELECT s.seq, CAST(coalesce(sum(born), 0) AS BIGINT) AS n_new, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_resolved, CAST(coalesce(sum(born), 0) - coalesce(sum(gone), 0) AS BIGINT) AS net FROM {snapshots} s LEFT JOIN e ON s.seq = e.seq GROUP BY s.seq"""


@operator("w_01_defect_velocity", "snapshot_keys", "snapshots")
def w_01(d: Dialect) -> str:
    return velocity()


@operator("u_04_key_set_difference", "snapshot_keys", "snapshots")
def u_04(d: Dialect) -> str:
    return f"SELECT seq, n_new + n_resolved AS changed FROM ({velocity()}) v"


@operator("w_02_burndown_rate", "snapshot_keys", "snapshots")
def w_02(d: Dialect) -> str:
    return f"SELECT CASE WHEN r.n = 0 THEN CASE WHEN r.r = 0 THEN 1.0 ELSE 0.0 END ELSE round(CAST(r.r AS DOUBLE) / r.n, 3) END AS burndown FROM (SELECT sum(n_new) AS n, sum(n_resolved) AS r FROM ({velocity()}) v) r"


@operator("a_25_distinct_keys", "snapshot_keys")
def a_25(d: Dialect) -> str:
    return "SELECT snapshot, count(*) AS n FROM {snapshot_keys} GROUP BY snapshot"


@operator("o_05_last_snapshots", "snapshots")
def o_05(d: Dialect) -> str:
    return "SELECT seq, snapshot FROM (SELECT seq, snapshot FROM {snapshots} ORDER BY seq DESC LIMIT 10) s ORDER BY seq"


@operator("l_03_training_gate", "texts", "labels")
def l_03(d: Dialect) -> str:
    return """
SELECT n, positives, CASE WHEN n >= 50 AND positives >= 10 AND n - positives >= 10 THEN 'TRAINED' ELSE 'INSUFFICIENT_DATA' END AS status
FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM {texts} t JOIN {labels} l ON t.doc_id = l.doc_id) s"""
