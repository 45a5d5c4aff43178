"""What stands beside the sources of a project: configuration, workspace manifest, baseline, version control, rule packs, and the guard of its path.

These are small files that one process reads; their content becomes parameters or rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.scratch import Scratch
from girder.sources import report

#: Parameters with their scope, default, least and most.
PARAMETERS = (
    ("max_component_depth", "dependency", 2, 1, 10),
    ("centrality_threshold", "architecture", 0.35, 0.0, 1.0),
    ("fan_out", "architecture", 10, 1, 1000),
    ("chain_depth", "architecture", 5, 1, 100),
    ("max_active_paths", "dataflow", 8, 1, 64),
    ("max_total_path_states", "dataflow", 128, 1, 4096),
    ("max_branch_depth", "dataflow", 6, 1, 32),
    ("max_conditions_per_path", "dataflow", 16, 1, 128),
    ("max_cfg_blocks", "dataflow", 64, 1, 1024),
    ("max_points_to_candidates", "dataflow", 4, 1, 16),
    ("max_fields_per_object", "dataflow", 16, 1, 64),
    ("max_objects_per_function", "dataflow", 32, 1, 128),
    ("max_alias_iterations", "dataflow", 5, 1, 20),
    ("max_taint_depth", "dataflow", 25, 1, 100),
    ("max_call_depth", "callgraph", 5, 1, 20),
    ("max_k", "callgraph", 2, 1, 2),
    ("max_contexts_per_function", "callgraph", 8, 1, 32),
    ("max_summary_iterations", "callgraph", 5, 1, 20),
    ("interprocedural", "callgraph", True, None, None),
    ("max_cached_contracts", "contract", 2000, 1, 100000),
    ("max_effects_per_summary", "contract", 16, 1, 128),
    ("max_field_effect_depth", "contract", 3, 1, 10),
    ("max_contract_composition_depth", "composition", 5, 1, 20),
    ("max_exception_contracts", "composition", 16, 1, 128),
    ("max_contract_conflicts", "composition", 32, 1, 256),
    ("max_container_fields", "composition", 16, 1, 128),
    ("max_project_contract_nodes", "composition", 1000, 1, 100000),
    ("enabled_rules", "rules", None, None, None),
    ("disabled_rules", "rules", (), None, None),
    ("fail_on", "gate", None, None, None),
    ("exclude", "paths", (), None, None),
    ("include", "paths", (), None, None),
    ("baseline", "comparison", None, None, None),
    ("format", "reporting", "terminal", None, None),
    ("top", "reporting", 25, 1, 1000),
    ("policy_mode", "policy", "ENFORCE", None, None),
)
SECTIONS = ("analysis", "paths", "comparison", "reporting")
LEVELS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Folders that are never a project.
SYSTEM = ("/", "/bin", "/boot", "/dev", "/etc", "/lib", "/lib64", "/proc", "/root/.ssh", "/run", "/sbin", "/sys", "/usr", "/var", "c:\\", "c:\\windows", "c:\\program files")


class Invalid(ValueError):
    """A file that says what it may not."""


# a reader of the part of YAML that such files use: mappings, lists, scalars, comments, flow lists


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ("[", "{") or (text[:1] == text[-1:] == '"' and len(text) > 1):
        try:
            return json.loads(text)
        except ValueError:
            return [_scalar(x) for x in text[1:-1].split(",") if x.strip()] if text[:1] == "[" else text
    if text[:1] == text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _bare(line: str) -> str:
    """A line without its comment."""
    out, quote = [], ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            break
        out.append(c)
    return "".join(out).rstrip()


_KEY = re.compile(r"""^("[^"]*"|'[^']*'|[^\s:#\-\[{][^:]*?)\s*:(?:\s+(.*)|)$""")


def load_yaml(text: str) -> Any:
    """Mappings and lists by indentation; JSON is read as such."""
    if text.lstrip()[:1] in ("{", "["):
        return json.loads(text)
    lines = [(len(b) - len(b.lstrip()), b.strip()) for raw in text.splitlines() if (b := _bare(raw)).strip() and b.strip() != "---"]

    def block(i: int, indent: int) -> tuple[Any, int]:
        if i >= len(lines) or lines[i][0] < indent:
            return None, i
        indent = lines[i][0]
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out: list = []
            while i < len(lines) and lines[i][0] == indent and (lines[i][1].startswith("- ") or lines[i][1] == "-"):
                rest = lines[i][1][1:].strip()
                if _KEY.match(rest):
                    lines[i] = (indent + 2, rest)
                    value, i = block(i, indent + 1)
                elif rest:
                    value, i = _scalar(rest), i + 1
                else:
                    value, i = block(i + 1, indent + 1)
                out.append(value)
            return out, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == indent:
            m = _KEY.match(lines[i][1])
            if not m:
                raise Invalid(f"not a mapping: {lines[i][1]}")
            key = m[1].strip("'\"")
            if key in found:
                raise Invalid(f"{key} twice")
            if (m[2] or "").strip():
                found[key], i = _scalar(m[2]), i + 1
            elif i + 1 < len(lines) and lines[i + 1][0] == indent and lines[i + 1][1].startswith("-"):
                found[key], i = block(i + 1, indent)
            else:
                found[key], i = block(i + 1, indent + 1)
        if i < len(lines) and lines[i][0] > indent:
            raise Invalid(f"indented too far: {lines[i][1]}")
        return found, i

    value, at = block(0, 0)
    if at < len(lines):
        raise Invalid(f"indented too little: {lines[at][1]}")
    return value


def _checked(name: str, value: Any) -> Any:
    for key, _, default, low, high in PARAMETERS:
        if key != name:
            continue
        if isinstance(default, bool) and not isinstance(value, bool):
            raise Invalid(f"{name} must be true or false")
        if low is not None and (isinstance(value, bool) or not isinstance(value, int | float) or (isinstance(default, int) and not isinstance(value, int)) or not low <= value <= high):
            raise Invalid(f"{name} must lie from {low} to {high}")
        if name == "fail_on" and value is not None and str(value).upper() not in LEVELS:
            raise Invalid(f"{name} must be one of {', '.join(LEVELS)}")
        if isinstance(default, tuple) and not (isinstance(value, list | tuple) and all(isinstance(x, str) for x in value)):
            raise Invalid(f"{name} must be a list of texts")
        return tuple(value) if isinstance(value, list) else str(value).upper() if name == "fail_on" and value is not None else value
    raise Invalid(f"unknown setting {name}")


def configuration(text: str | None = None, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """All parameters: what was given on the command line comes before the project's file, that before the defaults."""
    out = {k: default for k, _, default, _, _ in PARAMETERS}
    held = load_yaml(text) if text and text.strip() else {}
    if not isinstance(held, dict):
        raise Invalid("the configuration must be a mapping")
    for section, values in held.items():
        if section == "version":
            continue
        if section not in SECTIONS:
            raise Invalid(f"unknown section {section}")
        for k, v in (values or {}).items():
            name = "fail_on" if k == "fail_on_severity" else k
            out[name] = _checked(name, v)
    for k, v in (given or {}).items():
        if v is not None:
            out[k] = _checked(k, v)
    return out


def digest(payload: Any) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


def scoped_digests(config: dict[str, Any]) -> dict[str, str]:
    """A digest for each scope, so that a change of one setting invalidates only what depends on it."""
    scopes: dict[str, dict[str, Any]] = {}
    for k, scope, *_ in PARAMETERS:
        scopes.setdefault(scope, {})[k] = config[k]
    return {"parsing": digest({"reader": 1, "languages": ["python", "javascript", "typescript", "go"]})} | {k: digest(v) for k, v in sorted(scopes.items())}


@dataclass(frozen=True)
class Member:
    id: str
    path: str
    role: str = "SERVICE"
    criticality: str = "MEDIUM"
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Workspace:
    workspace_id: str
    name: str
    organization_id: str | None = None
    repositories: tuple[Member, ...] = field(default_factory=tuple)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m.id, m.path, m.role, m.criticality, list(m.depends_on)) for m in self.repositories], "id string, path string, role string, criticality string, depends_on array<string>")


def workspace(text: str) -> Workspace:
    """A manifest; ids must be given and unique, dependencies must be members."""
    held = load_yaml(text)
    if not isinstance(held, dict) or not held.get("workspace_id") or not held.get("name"):
        raise Invalid("a workspace needs an id and a name")
    members = tuple(Member(str(r["id"]), str(r.get("path", ".")), str(r.get("role", "SERVICE")), str(r.get("criticality", "MEDIUM")).upper(), tuple(r.get("depends_on") or ())) for r in held.get("repositories") or [] if isinstance(r, dict) and r.get("id"))
    if len(members) != len(held.get("repositories") or []):
        raise Invalid("a repository without an id")
    ids = [m.id for m in members]
    if len(set(ids)) < len(ids):
        raise Invalid("two repositories of one id")
    if unknown := sorted({d for m in members for d in m.depends_on} - set(ids)):
        raise Invalid(f"unknown dependencies: {', '.join(unknown)}")
    return Workspace(str(held["workspace_id"]), str(held["name"]), held.get("organization_id"), members)


BASELINE = "findings array<struct<id:string,rule_id:string,severity:string,category:string,code_snippet:string,location:struct<file_path:string,line_start:int,col_start:int>>>"


#: The first and the last line of a result with a line a finding.
BASELINE_HEAD, BASELINE_TAIL = '{"layout":"a line a finding","findings":[', "]}"


def save_baseline(findings: DataFrame, path: str) -> None:
    """One document of all findings, written by tasks at their bytes, a line a finding in report order."""
    rows = report.in_order(findings, Scratch(findings.sparkSession, "baseline"))
    place = F.struct("file_path", F.col("line").alias("line_start"), F.col("col").alias("col_start"))
    value = F.to_json(F.struct("id", "rule_id", "severity", "category", F.col("snippet").alias("code_snippet"), place.alias("location")))
    report.joined(rows, rows.count(), value, BASELINE_HEAD + "\n", "\n" + BASELINE_TAIL + "\n", path, ",\n")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a saved result, as rows of the comparison's input; a result that can't be read is an error.

    A document that ``save_baseline`` wrote has a line a finding and is read by as many tasks as it has splits; any other is parsed by one task. Of
    the former ``input_pos`` follows the order of the lines and may leave out numbers.
    """
    lines = spark.read.text(path)
    first = lines.first()
    if first is not None and first["value"] == BASELINE_HEAD:
        if lines.where(F.col("value") == BASELINE_TAIL).isEmpty():
            raise Invalid(f"{path} has no end")
        finding = spark.createDataFrame([], BASELINE).schema["findings"].dataType.elementType
        rows = lines.where(~F.col("value").isin(BASELINE_HEAD, BASELINE_TAIL, "")).withColumn("input_pos", F.monotonically_increasing_id())
        each = rows.select("input_pos", F.from_json(F.regexp_replace("value", ",$", ""), finding, {"mode": "FAILFAST"}).alias("f"))
    else:
        raw = spark.read.schema(BASELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)
        each = raw.selectExpr("posexplode(findings) AS (input_pos, f)")
    return each.selectExpr("CAST(input_pos AS BIGINT) AS input_pos", "f.id", "f.rule_id", "f.location.file_path AS file_path", "f.location.line_start AS line", "coalesce(f.location.col_start, 0) AS col", "f.severity", "f.category", "coalesce(f.code_snippet, '') AS snippet")


def git_metadata(folder: str) -> dict[str, Any]:
    """Commit, branch and whether files differ; unknown where there is no repository or no git."""
    out: dict[str, Any] = {"commit": None, "branch": None, "dirty": None}
    at = Path(folder).resolve()
    root = next((p for p in (at, *at.parents) if (p / ".git").is_dir()), None)
    if root is None:
        return out
    head = (root / ".git/HEAD").read_text().strip()
    if head.startswith("ref: "):
        ref = head[5:]
        out["branch"] = ref.removeprefix("refs/heads/")
        loose, packed = root / ".git" / ref, root / ".git/packed-refs"
        if loose.is_file():
            out["commit"] = loose.read_text().strip()
        elif packed.is_file():
            out["commit"] = next((x.split()[0] for x in packed.read_text().splitlines() if x.endswith(" " + ref)), None)
    else:
        out["commit"] = head
    try:
        said = subprocess.run(["git", "-C", str(root), "status", "--porcelain"], capture_output=True, text=True, timeout=20, check=True)
        out["dirty"] = bool(said.stdout.strip())
    except (OSError, subprocess.SubprocessError):
        pass
    return out


def guarded(path: str) -> Path:
    """The project's folder, if there is one that may be read: no file, no root and no folder of the system."""
    if not path or not path.strip():
        raise Invalid("an empty path")
    at = Path(os.path.realpath(path.strip()))
    low = str(at).lower()
    if any(low == s or (s not in ("/", "c:\\") and low.startswith(s + os.sep)) for s in SYSTEM):
        raise Invalid(f"{at} belongs to the system")
    if not at.exists():
        raise FileNotFoundError(str(at))
    if not at.is_dir():
        raise Invalid(f"{at} is no folder")
    return at


def pack_order(parents: dict[str, list[str]], name: str) -> list[str]:
    """A pack and those that it extends, parents first, each once; a cycle is an error."""
    out: list[str] = []

    def visit(x: str, way: tuple[str, ...]) -> None:
        if x in way:
            raise Invalid(f"packs extend each other: {' > '.join((*way, x))}")
        if x not in parents:
            raise Invalid(f"unknown pack {x}")
        for p in parents[x]:
            visit(p, (*way, x))
        if x not in out:
            out.append(x)

    visit(name, ())
    return out
