"""Controls, frameworks and policies over findings that carry the columns of an audit.

``audit_findings`` gives events the ids of real rules and, by rule from the row, what an audit knows of a finding: the sink, the
sanitizers and checks seen on its way, its suppression. The operators compute controls and policies from those columns only.
"""

from __future__ import annotations

from girder.operators.findings import rank
from girder.plans.operator import Dialect, operator
from girder.plans.views import VIEWS, View

#: The rules, in order.
RULES = (*(f"SEC-PY-{i:03}" for i in range(1, 13)), *(f"SEC-JS-{i:03}" for i in range(1, 11)), *(f"ARC-{i:03}" for i in range(1, 10)))
#: Controls with the rules and the policies that they map.
CONTROLS = (
    ("PCI-6.2.4", "PCI", "SEC-PY-003 SEC-PY-005 SEC-PY-009 SEC-PY-010 SEC-PY-011 SEC-PY-012 SEC-JS-001 SEC-JS-003 SEC-JS-007 SEC-JS-008 SEC-JS-009 SEC-JS-010", "POL-SQL-01 POL-CMD-01 POL-DOM-01 POL-EVAL-01"),
    ("PCI-3.4", "PCI", "SEC-PY-001 SEC-PY-006 SEC-JS-004 SEC-JS-005", ""),
    ("PCI-8.3.1", "PCI", "SEC-PY-008", "POL-AUTHZ-01"),
    ("PCI-6.3.2", "PCI", "ARC-001 ARC-002 ARC-003 ARC-004 ARC-005 ARC-006 ARC-007 ARC-008 ARC-009", ""),
    ("PCI-6.5.10", "PCI", "SEC-PY-007 SEC-JS-002 SEC-JS-006", ""),
    ("HIPAA-164.312(a)(1)", "HIPAA", "SEC-PY-008", "POL-AUTHZ-01"),
    ("HIPAA-164.312(c)(1)", "HIPAA", "SEC-PY-005 SEC-PY-009 SEC-PY-011", "POL-SQL-01"),
    ("HIPAA-164.312(e)(1)", "HIPAA", "SEC-PY-007 SEC-JS-006 SEC-JS-002", ""),
    ("HIPAA-164.312(b)", "HIPAA", "SEC-PY-002", ""),
    ("SOC2-CC6.1", "SOC2", "SEC-PY-001 SEC-PY-008 SEC-JS-004", "POL-AUTHZ-01"),
    ("SOC2-CC6.6", "SOC2", "SEC-PY-003 SEC-PY-010 SEC-PY-012 SEC-JS-003 SEC-JS-007 SEC-JS-009", "POL-CMD-01 POL-DOM-01"),
    ("SOC2-CC6.8", "SOC2", "SEC-PY-004 SEC-JS-001 SEC-JS-008 SEC-JS-010", "POL-EVAL-01"),
    ("SOC2-CC7.1", "SOC2", "SEC-PY-002 SEC-PY-006 SEC-JS-005", ""),
    ("NIST-SI-10", "NIST", "SEC-PY-003 SEC-PY-005 SEC-PY-009 SEC-PY-010 SEC-PY-011 SEC-PY-012 SEC-JS-003 SEC-JS-007 SEC-JS-009", "POL-SQL-01 POL-CMD-01 POL-DOM-01"),
    ("NIST-AC-3", "NIST", "SEC-PY-008", "POL-AUTHZ-01"),
    ("NIST-SC-13", "NIST", "SEC-PY-001 SEC-PY-006 SEC-JS-004 SEC-JS-005", ""),
    ("NIST-SC-8", "NIST", "SEC-PY-007 SEC-JS-006", ""),
)
#: Policies in evaluation order: id, sink, required property, allowed sanitizers, rules, needs authentication, needs authorization, mode.
POLICIES = (
    ("POL-SQL-01", "SQL_EXECUTE", "SQL_SAFE", "int float integer Literal psycopg2.sql.Literal", "SEC-PY-005 SEC-PY-009 SEC-PY-011", False, False, "ENFORCE"),
    ("POL-CMD-01", "COMMAND_EXECUTE", "COMMAND_SAFE", "shlex.quote int float", "SEC-PY-003 SEC-PY-010 SEC-PY-012", False, False, "ENFORCE"),
    ("POL-DOM-01", "DOM_INJECTION", "HTML_SAFE", "DOMPurify.sanitize sanitizeHtml html.escape escape int float", "SEC-JS-003 SEC-JS-007 SEC-JS-009", False, False, "ENFORCE"),
    ("POL-EVAL-01", "CODE_EVAL", "VALIDATED_TYPE", "int float", "SEC-PY-004 SEC-JS-001 SEC-JS-008 SEC-JS-010", False, False, "ENFORCE"),
    ("POL-AUTHZ-01", "", "", "", "SEC-PY-008", True, True, "ENFORCE"),
)
#: Which sanitizers and formats a boundary accepts, and which it can't stand: rule, accepted category, accepted types, accepted formats, incompatible categories.
BOUNDARIES = (
    ("SEC-PY-011", "SQL_EXECUTE", "int float bool integer", "numeric", "DOM_INJECTION COMMAND_EXECUTE"),
    ("SEC-PY-012", "COMMAND_EXECUTE", "", "alphanumeric", "SQL_EXECUTE DOM_INJECTION"),
    ("SEC-JS-009", "DOM_INJECTION", "int float bool", "numeric alphanumeric", "SQL_EXECUTE"),
    ("SEC-JS-010", "CODE_EVAL", "int float bool", "numeric", "DOM_INJECTION SQL_EXECUTE"),
)


def _rows(rows: list[tuple], names: str) -> str:
    said = lambda v: ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS v({names})"


CONTROL_RULES = _rows([(c, f, r) for c, f, rs, _ in CONTROLS for r in rs.split()], "control_id, framework, rule_id")
CONTROL_POLICIES = _rows([(c, f, p) for c, f, _, ps in CONTROLS for p in ps.split()], "control_id, framework, policy_id")
ALL_CONTROLS = _rows([(c, f) for c, f, _, _ in CONTROLS], "control_id, framework")
POLICY_RULES = _rows([(i, p[0], r) for i, p in enumerate(POLICIES) for r in p[4].split()], "ord, policy_id, rule_id")
POLICY_SANITIZERS = _rows([(p[0], s) for p in POLICIES for s in p[3].split()], "policy_id, sanitizer")
POLICY_ROWS = _rows([(i, p[0], p[1], p[2], p[5], p[6], p[7]) for i, p in enumerate(POLICIES)], "ord, policy_id, sink, required, need_auth, need_authz, mode")
SINKS = ("SQL_EXECUTE", "COMMAND_EXECUTE", "DOM_INJECTION", "CODE_EVAL")

_pick = lambda values, by: f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
VIEWS["audit_findings"] = View(
    ("findings",),
    f"""
SELECT input_pos, id, repo_id, file_path, line, severity, day, {_pick(RULES, f"(input_pos * 7 + user_id) % {len(RULES)}")} AS rule_id,
       CASE WHEN input_pos % 6 < 4 THEN {_pick(SINKS, "input_pos % 4")} ELSE '' END AS sink, {_pick(("int", "shlex.quote", "html.escape", ""), "input_pos % 5 % 4")} AS sanitizer,
       input_pos % 3 <> 0 AS has_auth, input_pos % 5 <> 0 AS has_authz, {_pick(("SQL_SAFE", "COMMAND_SAFE", "HTML_SAFE", ""), "(input_pos + line) % 4")} AS property,
       {_pick(("SUPPRESSED", "EXPIRED_SUPPRESSION", "DEFERRED"), "input_pos % 11")} AS suppression, CASE WHEN input_pos % 22 = 0 THEN '2024-01-15' END AS expires,
       input_pos % 13 = 0 AS accepted, {_pick(("int", "str", "bool", ""), "input_pos % 7 % 4")} AS value_type, {_pick(("numeric", "alphanumeric", ""), "line % 3")} AS value_format
FROM {{findings}}""".strip(),
)


def suppressed(x: str = "f") -> str:
    """An expired suppression doesn't count; an accepted risk and one that is suppressed or deferred does."""
    return f"CASE WHEN {x}.suppression = 'EXPIRED_SUPPRESSION' OR ({x}.expires IS NOT NULL AND {x}.expires < {x}.day) THEN false WHEN {x}.accepted THEN true ELSE coalesce({x}.suppression IN ('SUPPRESSED', 'DEFERRED'), false) END"


@operator("f_07_suppressed_predicate", "audit_findings")
def f_07(d: Dialect) -> str:
    return f"SELECT f.id, {suppressed()} AS suppressed FROM {{audit_findings}} f"


@operator("m_06_catalog")
def m_06(d: Dialect) -> str:
    return f"SELECT framework, count(*) AS controls FROM ({ALL_CONTROLS}) c GROUP BY framework"


@operator("s_15_controls_catalog")
def s_15(d: Dialect) -> str:
    return f"SELECT control_id, framework, {d.joined('rule_id')} AS rules FROM ({CONTROL_RULES}) c GROUP BY control_id, framework"


def first_policy() -> str:
    """(id, ord) of the first policy that applies: a rule or a sink is asked for only where both sides name one."""
    applies = f"p.mode <> 'DISABLED' AND (p.sink = '' OR f.sink = '' OR p.sink = f.sink)"  # noqa: F541
    return f"SELECT f.id, min(p.ord) AS ord FROM {{audit_findings}} f JOIN ({POLICY_RULES}) r ON r.rule_id = f.rule_id JOIN ({POLICY_ROWS}) p ON p.policy_id = r.policy_id AND {applies} GROUP BY f.id"


@operator("f_06_policy_applicability", "audit_findings")
def f_06(d: Dialect) -> str:
    return f"SELECT f.id, p.policy_id FROM {{audit_findings}} f JOIN ({POLICY_RULES}) r ON r.rule_id = f.rule_id JOIN ({POLICY_ROWS}) p ON p.policy_id = r.policy_id AND p.mode <> 'DISABLED' AND (p.sink = '' OR f.sink = '' OR p.sink = f.sink)"


@operator("j_13_first_policy", "audit_findings")
def j_13(d: Dialect) -> str:
    return f"SELECT x.id, p.policy_id FROM ({first_policy()}) x JOIN ({POLICY_ROWS}) p ON p.ord = x.ord"


def evaluation() -> str:
    """Authentication, then authorization, then an allowed sanitizer, then the required property; what is missing is an obligation."""
    return f"""
SELECT f.id, p.policy_id, p.mode,
       CASE WHEN p.need_auth AND NOT f.has_auth THEN 'AUTHENTICATION' WHEN p.need_authz AND NOT f.has_authz THEN 'AUTHORIZATION' WHEN s.sanitizer IS NOT NULL OR p.required = '' OR p.required = f.property THEN '' ELSE p.required END AS obligation
FROM ({first_policy()}) x JOIN ({POLICY_ROWS}) p ON p.ord = x.ord JOIN {{audit_findings}} f ON f.id = x.id LEFT JOIN ({POLICY_SANITIZERS}) s ON s.policy_id = p.policy_id AND s.sanitizer = f.sanitizer"""


@operator("c_14_policy_evaluation", "audit_findings")
def c_14(d: Dialect) -> str:
    return f"SELECT id, policy_id, obligation, CASE WHEN obligation = '' THEN 'PROVEN_SAFE' ELSE 'PROVEN_VIOLATION' END AS state FROM ({evaluation()}) e"


@operator("c_15_policy_filter", "audit_findings")
def c_15(d: Dialect) -> str:
    """Findings that an enforced policy has proven safe go; the others carry what was found."""
    return f"SELECT f.id, e.policy_id, e.obligation FROM {{audit_findings}} f LEFT JOIN ({evaluation()}) e ON e.id = f.id WHERE NOT (e.id IS NOT NULL AND e.mode = 'ENFORCE' AND e.obligation = '')"


@operator("j_12_finding_control", "audit_findings")
def j_12(d: Dialect) -> str:
    """By rule, or by the policy that was applied; a finding once a control."""
    return related()


def related() -> str:
    return f"""
SELECT f.id, c.control_id FROM {{audit_findings}} f JOIN ({CONTROL_RULES}) c ON c.rule_id = f.rule_id
UNION SELECT x.id, c.control_id FROM ({first_policy()}) x JOIN ({POLICY_ROWS}) p ON p.ord = x.ord JOIN ({CONTROL_POLICIES}) c ON c.policy_id = p.policy_id"""


def controls() -> str:
    """A row a repository and control. Findings are counted by (repository, control) first, so the controls meet counts."""
    return f"""
SELECT r.repo_id, c.control_id, c.framework, CAST(coalesce(n.active, 0) AS BIGINT) AS active, CAST(coalesce(n.hidden, 0) AS BIGINT) AS suppressed,
       CAST(CASE WHEN coalesce(n.active, 0) > 0 THEN round(greatest(0.0, 1.0 - 0.2 * CAST(n.active AS DOUBLE)), 4) WHEN coalesce(n.hidden, 0) > 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS score,
       CASE WHEN coalesce(n.active, 0) > 0 THEN 'VIOLATED' WHEN coalesce(n.hidden, 0) > 0 THEN 'PARTIAL' ELSE 'COMPLIANT' END AS status
FROM (SELECT DISTINCT repo_id FROM {{audit_findings}}) r CROSS JOIN ({ALL_CONTROLS}) c
LEFT JOIN (SELECT f.repo_id, m.control_id, sum(CASE WHEN {suppressed()} THEN 0 ELSE 1 END) AS active, sum(CASE WHEN {suppressed()} THEN 1 ELSE 0 END) AS hidden FROM ({related()}) m JOIN {{audit_findings}} f ON f.id = m.id GROUP BY f.repo_id, m.control_id) n
ON n.repo_id = r.repo_id AND n.control_id = c.control_id"""


@operator("a_13_control_evaluation", "audit_findings")
def a_13(d: Dialect) -> str:
    return controls()


@operator("a_13_strict", "audit_findings")
def a_13_strict(d: Dialect) -> str:
    """Strict mode: a control without active findings is proven only if every finding of it was evaluated by a policy; else unknown, at half."""
    return f"""
SELECT k.repo_id, k.control_id, CASE WHEN k.status = 'VIOLATED' THEN 'VIOLATED' WHEN coalesce(n.open, 0) = 0 THEN 'PROVEN' ELSE 'UNKNOWN' END AS status, CASE WHEN k.status = 'VIOLATED' THEN k.score WHEN coalesce(n.open, 0) = 0 THEN 1.0 ELSE 0.5 END AS score
FROM ({controls()}) k LEFT JOIN (SELECT f.repo_id, m.control_id, count(*) AS open FROM ({related()}) m JOIN {{audit_findings}} f ON f.id = m.id LEFT JOIN ({evaluation()}) e ON e.id = f.id WHERE e.id IS NULL GROUP BY f.repo_id, m.control_id) n ON n.repo_id = k.repo_id AND n.control_id = k.control_id"""


def assessment() -> str:
    return f"""
SELECT repo_id, framework, round(100.0 * CAST(avg(score) AS DOUBLE), 1) AS score, count(*) AS controls, CAST(sum(CASE WHEN status = 'VIOLATED' THEN 1 ELSE 0 END) AS BIGINT) AS violated, CAST(sum(CASE WHEN status = 'PARTIAL' THEN 1 ELSE 0 END) AS BIGINT) AS partial,
       CASE WHEN max(CASE WHEN status = 'VIOLATED' THEN 1 ELSE 0 END) = 1 THEN 'VIOLATED' WHEN max(CASE WHEN status = 'PARTIAL' THEN 1 ELSE 0 END) = 1 THEN 'PARTIAL' ELSE 'COMPLIANT' END AS status
FROM ({controls()}) x GROUP BY repo_id, framework"""


@operator("a_14_framework_assessment", "audit_findings")
def a_14(d: Dialect) -> str:
    return assessment()


@operator("a_15_suite", "audit_findings")
def a_15(d: Dialect) -> str:
    return f"SELECT repo_id, count(*) AS frameworks, round(avg(score), 1) AS score, CAST(sum(violated) AS BIGINT) AS violated FROM ({assessment()}) a GROUP BY repo_id"


@operator("m_01_evaluation", "audit_findings")
def m_01(d: Dialect) -> str:
    return f"SELECT x.repo_id, x.control_id, x.status, a.status AS framework_status, s.score AS suite_score FROM ({controls()}) x JOIN ({assessment()}) a ON a.framework = x.framework AND a.repo_id = x.repo_id JOIN ({a_15.text(d)}) s ON s.repo_id = x.repo_id"


@operator("c_10_boundary_matrix", "audit_findings")
def c_10(d: Dialect) -> str:
    """What crosses a boundary: a sanitizer that it can't stand violates; an accepted sanitizer, type or format satisfies; else unknown."""
    accepted = _rows([(r, a) for r, a, _, _, _ in BOUNDARIES], "rule_id, category")
    types = _rows([(r, t) for r, _, ts, _, _ in BOUNDARIES for t in ts.split()], "rule_id, value_type")
    formats = _rows([(r, t) for r, _, _, ts, _ in BOUNDARIES for t in ts.split()], "rule_id, value_format")
    bad = _rows([(r, t) for r, _, _, _, ts in BOUNDARIES for t in ts.split()], "rule_id, category")
    cleans = _rows([("int", "SQL_EXECUTE"), ("shlex.quote", "COMMAND_EXECUTE"), ("html.escape", "DOM_INJECTION")], "sanitizer, category")
    return f"""
SELECT f.id, CASE WHEN x.category IS NOT NULL THEN 'VIOLATED' WHEN a.category IS NOT NULL OR t.value_type IS NOT NULL OR o.value_format IS NOT NULL THEN 'SATISFIED' ELSE 'UNKNOWN' END AS state
FROM {{audit_findings}} f JOIN ({accepted}) b ON b.rule_id = f.rule_id LEFT JOIN ({cleans}) c ON c.sanitizer = f.sanitizer LEFT JOIN ({bad}) x ON x.rule_id = f.rule_id AND x.category = c.category
LEFT JOIN ({accepted}) a ON a.rule_id = f.rule_id AND a.category = c.category LEFT JOIN ({types}) t ON t.rule_id = f.rule_id AND t.value_type = f.value_type LEFT JOIN ({formats}) o ON o.rule_id = f.rule_id AND o.value_format = f.value_format"""


VIEWS["policy_catalog"] = View(
    ("supplier",),
    f"SELECT s_suppkey AS policy_id, {_pick(SINKS, 's_nationkey % 4')} AS sink, CAST(s_nationkey AS INT) AS boundary, s_acctbal > 0 AS require_auth, CAST(s_suppkey % 3 AS INT) AS version FROM {{supplier}}",
)
VIEWS["sanitizer_changes"] = View(("policy_catalog",), "SELECT policy_id AS change_id, CASE WHEN boundary % 5 = 4 THEN 'FILE_PATH' ELSE sink END AS category FROM {policy_catalog} WHERE version > 0")


@operator("c_12_affected_boundary_rules", "sanitizer_changes", "audit_findings")
def c_12(d: Dialect) -> str:
    """Boundary rules that a change of a sanitizer or sink touches, as its category is among those that the rule accepts or is the rule's sink, and how many findings are to be looked at again.

    A rule without findings counts none; a category of no rule touches none. Findings are counted a rule before changes meet them.
    """
    accepted = _rows([(r, a) for r, accepts, _, _, _ in BOUNDARIES for a in accepts.split()], "rule_id, category")
    return f"SELECT c.change_id, c.category, a.rule_id, coalesce(n.findings, 0) AS findings FROM {{sanitizer_changes}} c JOIN ({accepted}) a ON a.category = c.category LEFT JOIN (SELECT rule_id, count(*) AS findings FROM {{audit_findings}} GROUP BY rule_id) n ON n.rule_id = a.rule_id"


@operator("a_28_policy_conflicts", "policy_catalog")
def a_28(d: Dialect) -> str:
    """Groups of policies over one sink and boundary of which one asks for authentication and another does not."""
    return "SELECT sink, boundary, count(*) AS policies FROM {policy_catalog} GROUP BY sink, boundary HAVING max(CASE WHEN require_auth THEN 1 ELSE 0 END) = 1 AND min(CASE WHEN require_auth THEN 1 ELSE 0 END) = 0"


#: Rules of a parent pack and of a child pack: rule, enabled, severity, a threshold, whether it is locked.
PARENT_PACK = _rows([("SEC-PY-001", True, "HIGH", 12, True), ("SEC-PY-003", True, "CRITICAL", 1, True), ("ARC-002", True, "MEDIUM", 10, False), ("ARC-004", True, "LOW", 5, True), ("SEC-JS-006", False, "MEDIUM", 1, False)], "rule_id, enabled, severity, threshold, locked")
CHILD_PACK = _rows([("SEC-PY-001", False, "HIGH", 12, False), ("SEC-PY-003", True, "MEDIUM", 1, False), ("ARC-002", True, "LOW", 30, False), ("ARC-004", True, "MEDIUM", 9, False), ("SEC-JS-010", True, "CRITICAL", 1, False)], "rule_id, enabled, severity, threshold, locked")


@operator("u_08_rule_pack_merge")
def u_08(d: Dialect) -> str:
    """The last writer wins, but a locked rule may not be disabled, demoted or given a laxer threshold: the parent's value stays."""
    relaxed = f"p.locked AND (NOT c.enabled OR {rank('c.severity')} < {rank('p.severity')} OR c.threshold > p.threshold)"
    pick = lambda col: f"CASE WHEN c.rule_id IS NULL OR ({relaxed}) THEN p.{col} ELSE c.{col} END AS {col}"
    return f"SELECT coalesce(c.rule_id, p.rule_id) AS rule_id, {pick('enabled')}, {pick('severity')}, {pick('threshold')}, coalesce({relaxed}, false) AS refused FROM ({PARENT_PACK}) p FULL OUTER JOIN ({CHILD_PACK}) c ON c.rule_id = p.rule_id"


@operator("c_17_monotonic_packs")
def c_17(d: Dialect) -> str:
    """What a child pack may not do to a locked rule of its parent, a row a violation."""
    arms = (("DISABLED", "NOT c.enabled"), ("DEMOTED", f"{rank('c.severity')} < {rank('p.severity')}"), ("RELAXED", "c.threshold > p.threshold"))
    return " UNION ALL ".join(f"SELECT p.rule_id, '{k}' AS violation FROM ({PARENT_PACK}) p JOIN ({CHILD_PACK}) c ON c.rule_id = p.rule_id WHERE p.locked AND {on}" for k, on in arms)


# causes of regressions

VIEWS["file_versions"] = View(
    ("customer",),
    "SELECT concat('user/', CAST(c_custkey AS STRING)) AS file_path, md5(c_name) AS old_hash, CASE WHEN c_custkey % 7 = 0 THEN md5(concat(c_name, 'v2')) ELSE md5(c_name) END AS new_hash FROM {customer}",
)
VIEWS["rule_versions"] = View(
    ("events",),
    "SELECT DISTINCT event_type AS rule_id, 1 AS old_version, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS new_version, event_type = 'view' AS policy_changed FROM {events}",
)


@operator("p_21_regression_cause", "current_findings", "baseline_findings", "file_versions", "rule_versions")
def p_21(d: Dialect) -> str:
    """Why a finding is there: in a file that did not change a new finding comes from its policy or its rule; in a changed one from the code."""
    from girder.operators.matching import baseline_diff

    fresh = "x.transition IN ('NEW', 'MODIFIED')"
    same = "coalesce(v.old_hash = v.new_hash, false)"
    return f"""
SELECT x.c_pos, x.transition, CASE WHEN {fresh} AND {same} AND r.policy_changed THEN 'POLICY_CHANGE' WHEN {fresh} AND {same} AND r.old_version <> r.new_version THEN 'RULE_CHANGE' WHEN {fresh} THEN 'CODE_CHANGE' ELSE 'PRE_EXISTING' END AS cause,
       CASE WHEN {rank("x.severity")} >= 4 THEN 'BLOCKING' WHEN {rank("x.severity")} = 3 THEN 'ACTIONABLE' ELSE 'ADVISORY' END AS urgency
FROM ({baseline_diff(d)}) x JOIN {{current_findings}} f ON f.input_pos = x.c_pos LEFT JOIN {{file_versions}} v ON v.file_path = f.file_path LEFT JOIN {{rule_versions}} r ON r.rule_id = f.rule_id WHERE x.c_pos >= 0"""


@operator("c_16_policy_induced_transition", "current_findings", "baseline_findings", "file_versions", "rule_versions")
def c_16(d: Dialect) -> str:
    """New and resolved findings of rules whose policy changed, in files that did not."""
    from girder.operators.matching import baseline_diff

    hit = "coalesce(v.old_hash = v.new_hash, false) AND coalesce(r.policy_changed, false)"
    return f"""
SELECT x.c_pos, x.b_pos, CASE WHEN x.transition = 'NEW' AND {hit} THEN 'POLICY_INDUCED_NEW' WHEN x.transition = 'RESOLVED' AND {hit} THEN 'POLICY_INDUCED_RESOLVED' ELSE x.transition END AS transition
FROM ({baseline_diff(d)}) x LEFT JOIN {{current_findings}} c ON c.input_pos = x.c_pos LEFT JOIN {{baseline_findings}} b ON b.input_pos = x.b_pos
LEFT JOIN {{file_versions}} v ON v.file_path = coalesce(c.file_path, b.file_path) LEFT JOIN {{rule_versions}} r ON r.rule_id = coalesce(c.rule_id, b.rule_id)"""


@operator("f_11_gate_candidates", "current_findings", "baseline_findings", "file_versions", "rule_versions", "audit_findings")
def f_11(d: Dialect) -> str:
    """New and modified findings, less in this order those suppressed, induced by a policy, or known before."""
    return f"""
SELECT p.c_pos, CASE WHEN {suppressed('a')} THEN 'SUPPRESSED' WHEN p.cause = 'POLICY_CHANGE' THEN 'POLICY_INDUCED' WHEN p.cause = 'PRE_EXISTING' THEN 'PRE_EXISTING' ELSE 'CANDIDATE' END AS bucket
FROM ({p_21.text(d)}) p JOIN {{audit_findings}} a ON a.input_pos = p.c_pos WHERE p.transition IN ('NEW', 'MODIFIED')"""
