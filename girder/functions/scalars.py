"""Scalar functions over text, paths and sets, each as an operator that adds its columns."""

from __future__ import annotations

from girder.code import registry, rules
from girder.plans.operator import Dialect, operator
from girder.plans.views import VIEWS, View

#: Names, globs and markers of ignored and generated files.
EXCLUDED_DIRS = ("node_modules", "dist", "build", "vendor", "__pycache__")
GENERATED = (".pb.py", "_pb2.py", ".min.js", ".generated.ts")
ENTRY_NAMES = ("main.py", "app.py", "manage.py", "setup.py", "index.ts", "index.js")


@operator("p_01_path_normalise", "files")
def p_01(d: Dialect) -> str:
    return "SELECT pos, lower(trim(BOTH '/' FROM replace(concat('/', path, '/'), chr(92), '/'))) AS path_norm FROM {files}" if d.name == "spark" else "SELECT pos, lower(trim(replace(concat('/', path, '/'), chr(92), '/'), '/')) AS path_norm FROM {files}"


@operator("p_02_snippet_normalise", "texts")
def p_02(d: Dialect) -> str:
    return f"SELECT doc_id, {d.sha('trim(' + d.sub('text', '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]+', ' ') + ')')} AS snippet_hash FROM {{texts}}"


@operator("p_04_module_name", "files")
def p_04(d: Dialect) -> str:
    return f"SELECT pos, {d.sub("replace(path, '/', '.')", '[.]py$', '')} AS module FROM {{files}}"


@operator("p_08_content_hash", "texts")
def p_08(d: Dialect) -> str:
    return f"SELECT doc_id, {d.sha('replace(text, concat(chr(13), chr(10)), chr(10))')} AS content_hash FROM {{texts}}"


@operator("p_09_composite_hash", "files")
def p_09(d: Dialect) -> str:
    return f"SELECT pos, {d.sha("concat_ws(':', path, content_hash, language, 'p1', 's1', CASE WHEN path LIKE '%.pb.py' THEN '1' ELSE '0' END)")} AS composite FROM {{files}}"


@operator("p_11_generated_file", "files")
def p_11(d: Dialect) -> str:
    return f"SELECT pos, ({' OR '.join(f"path LIKE '%{s}'" for s in GENERATED)}) AS is_generated FROM {{files}}"


@operator("s_02_ignore_engine", "files")
def s_02(d: Dialect) -> str:
    dirs = " OR ".join(f"concat('/', path) LIKE '%/{x}/%'" for x in EXCLUDED_DIRS)
    return f"SELECT pos, path, ({dirs}) OR {d.has('path', '[.]min[.]js$')} AS ignored FROM {{files}}"


@operator("f_08_ignore_predicates", "files")
def f_08(d: Dialect) -> str:
    return f"SELECT count(*) AS kept FROM ({s_02.text(d)}) s WHERE NOT ignored"


@operator("s_03_file_kind", "pages_v")
def s_03(d: Dialect) -> str:
    return "SELECT page_id, position(chr(1) IN substr(html, 1, 1024)) > 0 AS is_binary, length(html) >= 8000 AND position(chr(10) IN substr(html, 1, 8000)) = 0 AS is_minified, length(html) - length(replace(html, chr(10), '')) + 1 AS line_count FROM {pages_v}"


@operator("f_09_entry_point_exemption", "files")
def f_09(d: Dialect) -> str:
    return f"SELECT pos, {d.has('path', '(^|/)(main|app|manage|setup|__init__)[.]py$|(^|/)index[.][a-z]+$|(^|/)tests?/|_test[.]|[.]spec[.]')} AS exempt FROM {{files}}"


@operator("f_02_rule_applicability", "files")
def f_02(d: Dialect) -> str:
    rules = "SELECT * FROM (VALUES ('R-PY', 'python', 'general'), ('R-JS', 'javascript', 'react'), ('R-ANY', '', 'general'), ('R-TS', 'typescript', '')) AS r(rule_id, language, framework)"
    return f"SELECT f.pos, r.rule_id FROM {{files}} f JOIN ({rules}) r ON (r.language = '' OR r.language = lower(f.language)) AND (r.framework IN ('', 'general') OR r.framework = 'react')"


#: What repositories ask for: rules whose findings weigh much are switched on, those whose findings weigh little off; some name rules that there are not.
VIEWS["rule_settings"] = View(
    ("findings",),
    """
SELECT repo_id, rule_id, CASE WHEN avg(value) > 51 THEN 'ENABLE' ELSE 'DISABLE' END AS action FROM {findings} GROUP BY repo_id, rule_id HAVING avg(value) > 51 OR avg(value) < 49
UNION ALL SELECT repo_id, lower(concat(category, '-', max(severity))), 'ENABLE' FROM {findings} GROUP BY repo_id, category HAVING avg(value) > 50""".strip(),
)


@operator("f_03_rule_activation", "findings", "rule_settings")
def f_03(d: Dialect) -> str:
    """Of each repository the rules of the registry with whether they run: those it enables, or all if it enables none that there is, without those it disables; ids that no rule has are rejected."""
    return """
WITH registry AS (SELECT DISTINCT rule_id FROM {findings}), repos AS (SELECT DISTINCT repo_id FROM {findings}),
known AS (SELECT s.repo_id, s.rule_id, s.action FROM {rule_settings} s JOIN registry r ON r.rule_id = s.rule_id),
named AS (SELECT repo_id, max(CASE WHEN action = 'ENABLE' THEN 1 ELSE 0 END) AS some FROM known GROUP BY repo_id)
SELECT p.repo_id, r.rule_id, (coalesce(n.some, 0) = 0 OR e.rule_id IS NOT NULL) AND x.rule_id IS NULL AS active, false AS rejected
FROM repos p JOIN registry r ON true LEFT JOIN named n ON n.repo_id = p.repo_id
LEFT JOIN (SELECT DISTINCT repo_id, rule_id FROM known WHERE action = 'ENABLE') e ON e.repo_id = p.repo_id AND e.rule_id = r.rule_id
LEFT JOIN (SELECT DISTINCT repo_id, rule_id FROM known WHERE action = 'DISABLE') x ON x.repo_id = p.repo_id AND x.rule_id = r.rule_id
UNION ALL SELECT DISTINCT s.repo_id, s.rule_id, false, true FROM {rule_settings} s LEFT JOIN registry r ON r.rule_id = s.rule_id WHERE r.rule_id IS NULL"""


def entropy(d: Dialect, x: str) -> str:
    """Bits a character of x; the characters are taken in order, so that sums come out alike everywhere."""
    share = f"CAST(length({x}) - length(replace({x}, c, '')) AS DOUBLE) / length({x})"
    if d.name == "spark":
        return f"aggregate(array_sort(array_distinct(filter(split({x}, ''), c -> c <> ''))), CAST(0 AS DOUBLE), (acc, c) -> acc - {share} * log2({share}))"
    return f"coalesce(list_sum(list_transform(list_sort(list_distinct(string_split({x}, ''))), lambda c: -({share}) * log2({share}))), 0.0)"


#: Prefixes of known secrets, and literals that are none.
SECRET_PREFIXES, PLACEHOLDERS = rules.SECRET_PREFIXES, tuple(sorted(rules.PLACEHOLDERS))
TOKEN = "(?:token|secret|password|api_key)[ ]*[=:][ ]*[\"']([^\"']+)[\"']"


def likely_secret(d: Dialect, x: str) -> str:
    """No placeholder and no reference to a variable; a known prefix, or length and entropy."""
    known = " OR ".join(f"{x} LIKE '{p.replace('_', '!_')}%' ESCAPE '!'" for p in SECRET_PREFIXES)
    benign = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return f"(lower(trim({x})) NOT IN ({benign}) AND NOT ({x} LIKE '$%' AND position(' ' IN {x}) = 0) AND ({known} OR (length({x}) >= {rules.LEAST_LENGTH} AND round({entropy(d, x)}, 3) >= {rules.LEAST_ENTROPY})))"


def _tokens(d: Dialect) -> str:
    """A row an assignment."""
    if d.name == "spark":
        return f"SELECT doc_id, secret FROM {{texts}} LATERAL VIEW explode(regexp_extract_all(text, {d.re(TOKEN)}, 1)) m AS secret"
    return f"SELECT doc_id, unnest(regexp_extract_all(text, {d.re(TOKEN)}, 1)) AS secret FROM {{texts}}"


@operator("p_12_shannon_entropy", "texts")
def p_12(d: Dialect) -> str:
    return f"SELECT doc_id, round({entropy(d, 'secret')}, 3) AS bits FROM ({_tokens(d)}) t"


@operator("p_13_secret_predicate", "texts")
def p_13(d: Dialect) -> str:
    return f"SELECT doc_id, {likely_secret(d, 'secret')} AS is_secret FROM ({_tokens(d)}) t"


REDACTED = "CASE WHEN length(secret) <= 6 THEN '***' ELSE concat(substr(secret, 1, 3), '...', substr(secret, length(secret) - 1)) END"


@operator("sec_py_001_secrets", "texts")
def sec_py_001(d: Dialect) -> str:
    return f"SELECT doc_id, {REDACTED} AS redacted, 'HIGH' AS severity FROM ({_tokens(d)}) t WHERE {likely_secret(d, 'secret')}"


@operator("p_14_redact_secret", "texts")
def p_14(d: Dialect) -> str:
    return f"SELECT doc_id, {REDACTED} AS redacted FROM ({_tokens(d)}) t"


#: Ordered replacements of the scrubber.
SCRUB = (
    ("AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    ("gh[pousr]_[A-Za-z0-9]{36}", "[GITHUB_TOKEN]"),
    ("xox[baprs]-[A-Za-z0-9-]{10,}", "[SLACK_TOKEN]"),
    ("(postgres|mysql|mongodb|redis)://[^ ]+", "[DB_URL]"),
    ("eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", "[JWT]"),
    ("Bearer [A-Za-z0-9._-]{16,}", "Bearer [TOKEN]"),
    ('(password|secret|token|api_key) *= *"[^"]+"', "[ASSIGNMENT]"),
)


@operator("p_15_scrub_text", "texts")
def p_15(d: Dialect) -> str:
    x = "text"
    for pattern, to in SCRUB:
        x = d.sub(x, pattern, to)
    return f"SELECT doc_id, {d.sha(x)} AS scrubbed_hash, {x} <> text AS changed FROM {{texts}}"


@operator("p_16_spreadsheet_sanitise", "texts")
def p_16(d: Dialect) -> str:
    clean = d.sub("coalesce(text, '')", r"[^\t\n\r -\uD7FF]" if d.name == "spark" else r"[^\t\n\r -\x{D7FF}]", "")
    return f"SELECT doc_id, CASE WHEN {d.has('clean', r'^[=+@\t\r-]')} THEN concat(chr(39), clean) ELSE clean END AS cell FROM (SELECT doc_id, {clean} AS clean FROM {{texts}}) t"


@operator("p_29_slugify", "files")
def p_29(d: Dialect) -> str:
    return f"SELECT pos, {d.sub(d.sub('lower(path)', '[^a-z0-9]+', '-'), '^-|-$', '')} AS slug FROM {{files}}"


@operator("p_30_remediation_lookup", "findings")
def p_30(d: Dialect) -> str:
    t = "SELECT * FROM (VALUES ('error', 'Handle the error', 'LOW'), ('view', 'Escape the output', 'MEDIUM'), ('*', 'Review', 'HIGH')) AS t(pattern, fix, effort)"
    return f"SELECT f.id, coalesce(a.fix, b.fix) AS fix, coalesce(a.effort, b.effort) AS effort FROM {{findings}} f LEFT JOIN ({t}) a ON a.pattern = f.rule_id JOIN ({t}) b ON b.pattern = '*'"


@operator("p_32_context_budget", "texts")
def p_32(d: Dialect) -> str:
    n = "length(text) - length(replace(text, chr(10), '')) + 1"
    return f"SELECT doc_id, CASE WHEN {n} > 40 THEN 25 + 15 ELSE {n} END AS kept_lines FROM {{texts}}"


@operator("s_09_framework_detection", "files")
def s_09(d: Dialect) -> str:
    return f"""
SELECT framework, n AS evidence, round(CASE framework WHEN 'django' THEN least(0.98, 0.40 + 0.20 * n) WHEN 'flask' THEN least(0.95, 0.45 + 0.25 * n) ELSE least(0.98, 0.40 + 0.25 * n) END, 2) AS confidence
FROM (SELECT CASE WHEN language = 'python' AND path LIKE 'src/%' THEN 'django' WHEN language = 'python' THEN 'flask' ELSE 'express' END AS framework, CAST(count(*) AS DOUBLE) AS n FROM {{files}} GROUP BY 1) f"""


@operator("s_14_table_scan", "orders_v")
def s_14(d: Dialect) -> str:
    return "SELECT o_orderkey, o_totalprice FROM {orders_v} WHERE o_orderstatus = 'P' AND o_totalprice > 100000"


# responses: what a model could have said of the finding in a document's file. What it cites are the first two words of a document that may be the same
VIEWS["responses"] = View(
    ("documents", "files"),
    """
SELECT d.doc_id AS response_id, concat('F', CAST(d.doc_id AS STRING)) AS target_id, CASE WHEN length(d.text) % 9 > 0 THEN concat('F', CAST(d.doc_id - d.doc_id % 4 AS STRING)) END AS finding_id, f.path AS target_path,
       CASE length(d.text) % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', replace(f.path, '/', chr(92)), ' ') WHEN 2 THEN concat('/', f.path) ELSE f.path END AS patch_path, length(d.text) / 500.0 - 0.5 AS confidence,
       concat(CASE WHEN length(d.text) % 5 = 0 THEN '' ELSE concat('--- a/', f.path, chr(10)) END, '+++ b/', f.path, chr(10), '@@ -1 +1 @@') AS unified_diff, d.text AS snippet, CAST(length(d.text) % 40 AS INT) AS line_start,
       CASE WHEN d.lang = 'en' THEN CAST(length(d.source) * 4 AS INT) END AS line_end, coalesce(o.text, d.text) AS cites, d.text AS enclosing
FROM {documents} d LEFT JOIN {files} f ON f.pos = d.doc_id + 1 LEFT JOIN {documents} o ON o.doc_id = d.doc_id + length(d.text) % 2""".strip(),
)


@operator("l_08_response_validation", "responses", "files")
def l_08_response(d: Dialect) -> str:
    """What is left of a model's response about a finding: its id set right, confidence within bounds, the patch or why it is dropped, and what is not grounded.

    ``patch`` is KEPT, NONE where there is none, or the first test that it fails: it is of another file (OTHER_FILE), leaves the repository (TRAVERSAL), its
    file is not there (NO_FILE), the diff has no header (NO_HEADER), or the new text holds what looks like a secret (SECRET). Null texts are empty.
    ``problems``: lines that cannot be (LINES), no such file (FILE), and symbols that the code does not hold (SYMBOLS); ``unknown_symbols`` are the
    distinct ones, first words of ``cites``, in order. A null confidence counts as 0.
    """
    clean = lambda x: f"trim(replace({x}, chr(92), '/'))"
    secret = " OR ".join(d.has("coalesce(r.snippet, '')", pattern) for pattern, _ in SCRUB)
    words = d.split("coalesce(r.cites, '')", " ")
    cited = f"array_distinct(filter(array({d.at(words, '1')}, {d.at(words, '2')}), c -> trim(coalesce(c, '')) <> '' AND position(trim(c) IN coalesce(r.enclosing, '')) = 0))"
    if d.name == "duckdb":
        cited = f"list_filter([{d.at(words, '1')}, CASE WHEN {d.at(words, '2')} <> {d.at(words, '1')} THEN {d.at(words, '2')} END], lambda c: trim(coalesce(c, '')) <> '' AND position(trim(c) IN coalesce(r.enclosing, '')) = 0)"
    text = "array_join(u, ',')" if d.name == "spark" else "array_to_string(u, ',')"
    size = "size(u)" if d.name == "spark" else "len(u)"
    return f"""
SELECT response_id, target_id AS finding_id, finding_id IS NOT NULL AND finding_id <> target_id AS corrected, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(coalesce(confidence, 0) AS DOUBLE))) AS confidence,
 CASE WHEN patch_path IS NULL THEN 'NONE' WHEN p <> coalesce(t, '') THEN 'OTHER_FILE' WHEN position('..' IN p) > 0 OR p LIKE '/%' THEN 'TRAVERSAL' WHEN NOT there THEN 'NO_FILE'
      WHEN position('--- a/' IN coalesce(unified_diff, '')) = 0 OR position('+++ b/' IN coalesce(unified_diff, '')) = 0 THEN 'NO_HEADER' WHEN secret THEN 'SECRET' ELSE 'KEPT' END AS patch,
 concat_ws(',', CASE WHEN coalesce(line_start, 0) < 1 OR coalesce(line_end < line_start, false) THEN 'LINES' END, CASE WHEN NOT there THEN 'FILE' END, CASE WHEN {size} > 0 THEN 'SYMBOLS' END) AS problems, {text} AS unknown_symbols
FROM (SELECT r.*, {clean("r.patch_path")} AS p, {clean("r.target_path")} AS t, f.path IS NOT NULL AS there, {secret} AS secret, {cited} AS u
      FROM {{responses}} r LEFT JOIN (SELECT DISTINCT path FROM {{files}}) f ON f.path = {clean("r.target_path")}) x"""


@operator("l_08_patch_validation", "files")
def l_08(d: Dialect) -> str:
    return f"SELECT pos, {d.has('path', '[.][.]')} OR path LIKE '/%' AS traversal, {d.has('path', '[.](py|ts|js|go)$')} AS known_kind FROM {{files}}"


@operator("c_13_boundary_lines", "pages_v")
def c_13(d: Dialect) -> str:
    return f"SELECT page_id, CAST(count(*) AS BIGINT) AS boundaries FROM (SELECT page_id FROM {{pages_v}} {d.each(d.split('html', '>'), 'l')} WHERE position('href=' IN l.x) > 0) h GROUP BY page_id"


# lattices and registries


def _values(rows: tuple[tuple, ...], names: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS r({names})"


@operator("t_05_registries")
def t_05(d: Dialect) -> str:
    """Sources, sinks and sanitizers as rows; further ones are further rows."""
    rows = [("source", lang, f"{base}.{member}".lstrip("."), kind) for lang, kind, base, member in registry.SOURCES]
    rows += [("sink", lang, f"{base}.{callee}".lstrip("."), category) for lang, callee, base, category, _ in registry.SINKS]
    rows += [("sanitizer", lang, name, "+".join(sorted(categories))) for lang, name, categories in registry.SANITIZERS]
    return f"SELECT kind, language, name, detail FROM ({_values(tuple(rows), 'kind, language, name, detail')}) t"


@operator("t_15_call_strings", "calls")
def t_15(d: Dialect) -> str:
    """Contexts of the last two call sites; more than eight a function widen to one."""
    ctx = d.sha("concat(CAST(a.caller AS STRING), '>', CAST(b.caller AS STRING))")
    if d.name == "spark":
        # a caller's own callers are counted first: pairs of call sites are made only for functions that have eight at most
        return f"""
WITH c AS (SELECT DISTINCT caller, callee FROM {{calls}}), n AS (SELECT c.callee, sum(i.n) AS n FROM c JOIN (SELECT callee AS fn, count(*) AS n FROM c GROUP BY callee) i ON i.fn = c.caller GROUP BY c.callee)
SELECT callee, 'WIDENED' AS context, 9 AS n FROM n WHERE n > 8
UNION ALL SELECT callee, min(ctx), least(count(*), 9) FROM (SELECT DISTINCT b.callee, substr({ctx}, 1, 16) AS ctx FROM (SELECT c.* FROM c LEFT SEMI JOIN (SELECT callee FROM n WHERE n <= 8) k ON k.callee = c.callee) b JOIN c a ON a.callee = b.caller) x GROUP BY callee"""
    return f"""
SELECT callee, CASE WHEN count(*) > 8 THEN 'WIDENED' ELSE min(ctx) END AS context, least(count(*), 9) AS n
FROM (SELECT DISTINCT b.callee, substr({ctx}, 1, 16) AS ctx FROM {{calls}} b JOIN {{calls}} a ON a.callee = b.caller) x GROUP BY callee"""


@operator("a_27_call_graph_summary", "calls", "functions")
def a_27(d: Dialect) -> str:
    return "SELECT count(DISTINCT c.caller) AS callers, count(DISTINCT c.callee) AS callees, count(*) AS edges FROM {calls} c"


@operator("j_02_lookup_joins", "edges", "modules")
def j_02(d: Dialect) -> str:
    return "SELECT e.src, e.tgt, a.component AS src_component, b.component AS tgt_component FROM {edges} e JOIN {modules} a ON a.id = e.src JOIN {modules} b ON b.id = e.tgt"


@operator("j_22_eager_children", "turns")
def j_22(d: Dialect) -> str:
    return f"SELECT conv_id, count(*) AS n, {d.joined("concat(lpad(CAST(turn AS STRING), 4, '0'), role)")} AS children FROM {{turns}} GROUP BY conv_id"


@operator("k_12_snapshot_reconstruct", "findings")
def k_12(d: Dialect) -> str:
    """What a saved snapshot holds: counts by severity, and a digest that doesn't depend on the order of its rows (a sum of hashes, so it merges)."""
    h = "CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)" if d.name == "spark" else "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"
    counts = ", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
    return f"SELECT day, count(*) AS n, {counts}, CAST(sum({h.format(x="concat(rule_id, ':', CAST(input_pos AS STRING))" if d.name == 'spark' else "concat(rule_id, ':', CAST(input_pos AS VARCHAR))")}) AS BIGINT) AS digest FROM {{findings}} GROUP BY day"


@operator("a_07_architecture_summary", "edges", "modules", "findings")
def a_07(d: Dialect) -> str:
    return "SELECT (SELECT count(*) FROM {modules}) AS modules, (SELECT count(*) FROM {edges}) AS edges, (SELECT count(*) FROM {findings} WHERE category = 'ARCHITECTURE') AS findings"
