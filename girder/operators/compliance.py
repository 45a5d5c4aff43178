"""Controls, policies, contracts, fleets, audit chains."""

from __future__ import annotations

from girder.operators.findings import grade
from girder.plans.operator import Dialect, operator

WEIGHT = "CASE criticality WHEN 'CRITICAL' THEN 4.0 WHEN 'HIGH' THEN 2.5 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 0.5 ELSE 0.2 END"


@operator("a_16_fleet_control_rollup", "fleet")
def a_16(d: Dialect) -> str:
    return f"""
SELECT workspace, round(sum({WEIGHT} * health) / sum({WEIGHT}), 2) AS score, count(*) AS repos, {d.joined("CASE WHEN health < 40 THEN lpad(CAST(repo_id AS STRING), 8, '0') END")} AS failing
FROM (SELECT workspace, repo_id, criticality, CAST(health AS DOUBLE) AS health FROM {{fleet}}) f GROUP BY workspace"""


@operator("a_17_fleet_composite", "fleet")
def a_17(d: Dialect) -> str:
    return f"SELECT organisation, score, {grade('score')} AS grade FROM (SELECT organisation, round(sum(CAST({WEIGHT} AS DOUBLE) * health) / sum(CAST({WEIGHT} AS DOUBLE)), 1) AS score FROM {{fleet}} GROUP BY organisation) s"


@operator("j_21_finding_fleet_member", "findings", "fleet")
def j_21(d: Dialect) -> str:
    return f"SELECT r.repo_id, r.criticality, CAST({WEIGHT} AS DOUBLE) * f.n AS weighted FROM (SELECT user_id, count(*) AS n FROM {{findings}} GROUP BY user_id) f JOIN {{fleet}} r ON r.repo_id = f.user_id"


@operator("a_18_org_rollup", "fleet")
def a_18(d: Dialect) -> str:
    return "SELECT organisation, round(avg(latest), 1) AS score, count(*) AS workspaces FROM (SELECT organisation, workspace, max_by(health, repo_id) AS latest FROM {fleet} GROUP BY organisation, workspace) w GROUP BY organisation"


@operator("m_05_workspace_attestation", "fleet")
def m_05(d: Dialect) -> str:
    return "SELECT workspace, CASE WHEN avg(health) >= 70 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {fleet} GROUP BY workspace"


@operator("j_19_guarantee_requirement", "calls")
def j_19(d: Dialect) -> str:
    return "SELECT r.caller, r.callee, r.from_param, coalesce(g.to_param, -1) AS guaranteed, CASE WHEN g.callee IS NULL THEN 'UNKNOWN' ELSE 'BOUND' END AS edge FROM {calls} r LEFT JOIN (SELECT callee, from_param, min(to_param) AS to_param FROM {calls} WHERE caller % 2 = 0 GROUP BY callee, from_param) g ON g.callee = r.callee AND g.from_param = r.from_param"


@operator("c_05_epoch_invalidation", "turns")
def c_05(d: Dialect) -> str:
    return "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reassigned FROM {turns}) t WHERE reassigned IS NULL"


# audit chains


def _event_hash(d: Dialect, prev: str) -> str:
    return d.sha(f"concat_ws('|', CAST(conv_id AS STRING), CAST(turn AS STRING), role, text, {prev})")


@operator("w_08_chain_verify", "turns")
def w_08(d: Dialect) -> str:
    """Each event stores the hash of the event before; the first mismatch of a chain is its break."""
    own = d.sha("concat_ws('|', CAST(conv_id AS STRING), CAST(turn AS STRING), role, text)")
    return f"""
WITH e AS (SELECT conv_id, turn, {own} AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM {{turns}}),
s AS (SELECT conv_id, turn, pos, h, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS before, CASE WHEN pos = 0 THEN repeat('0', 64) WHEN conv_id % 17 = 0 AND turn = 2 THEN 'forged' ELSE lag(h) OVER (PARTITION BY conv_id ORDER BY turn) END AS stored FROM e)
SELECT conv_id, count(*) AS events, coalesce(min(CASE WHEN stored <> coalesce(before, repeat('0', 64)) OR pos <> turn THEN pos END), -1) AS first_break, {d.sha(d.joined("concat(lpad(CAST(pos AS STRING), 8, '0'), h)", ""))} AS seal FROM s GROUP BY conv_id"""


@operator("m_04_ledger_seal", "turns")
def m_04(d: Dialect) -> str:
    return f"SELECT conv_id, events, CASE WHEN first_break < 0 THEN 'VALID' ELSE 'BROKEN' END AS state FROM ({w_08.text(d)}) w"


# contracts across repositories


@operator("k_15_contract_catalog", "functions")
def k_15(d: Dialect) -> str:
    return f"SELECT file_id, {d.sha(d.joined('qualified_name', ';', distinct=True))} AS digest, count(*) AS contracts FROM {{functions}} GROUP BY file_id"
