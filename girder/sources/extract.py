"""Files to rows: the scan of a folder, and facts of Python syntax as the rules over facts take them.

Code is parsed inside Arrow batches (``mapInArrow``), a file a row in and a fact a row out; everything after that
is relational. The analyses of ``girder.code`` work on whole modules of three languages.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.code import flow, python
from girder.plans.operator import native, view
from girder.plans.views import VIEWS, View

FACTS = "path string, kind string, name string, detail string, line int, end_line int, scope string"
_SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("detail", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("scope", pa.string())])

#: Limits of a scan.
MOST_BYTES, MINIFIED_CHARS = 5_000_000, 8000
LANGUAGES = {"py": "PYTHON", "js": "JAVASCRIPT", "jsx": "JAVASCRIPT", "mjs": "JAVASCRIPT", "cjs": "JAVASCRIPT", "ts": "TYPESCRIPT", "tsx": "TYPESCRIPT", "go": "GO"}
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "pipfile", "manage.py")
EXCLUDED = ("node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".venv")


def catalogued(listing: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Of files (relative_path, size_bytes, content as bytes), with whatever else is known of them, those that an audit reads: with extension, language, line_count, is_source and is_manifest.

    Files below an excluded folder are left out. A source file has a known extension, is not larger than the bound, has no zero byte among its first
    1,024 and a line end among its first 8,000 characters, if it has as many; its content comes as text, with bytes that are no UTF-8 replaced. A
    manifest goes by its name; one that is no source file as well has neither text nor lines. Null contents are empty.
    """
    parts = F.split("relative_path", "/")
    ext = F.lower(F.regexp_extract("relative_path", r"[^/][.]([^./]+)$", 1))
    name = F.element_at(parts, -1)
    bytes_ = F.coalesce(F.col("content"), F.lit(b""))
    text = F.make_valid_utf8(bytes_.cast("string"))
    language = F.element_at(F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair]), ext)
    excluded = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED)))
    binary = F.position(F.lit(b"\0"), F.substring(bytes_, 1, 1024)) > 0
    minified = (F.length(text) >= MINIFIED_CHARS) & ~F.contains(F.substring(text, 1, MINIFIED_CHARS), F.lit("\n"))
    source = F.coalesce(language.isNotNull() & (F.col("size_bytes") <= most_bytes) & ~binary & ~minified, F.lit(False))
    # names and sizes are looked at before any content
    rows = listing.where(~excluded & (language.isNotNull() | F.lower(name).isin(*MANIFESTS)))
    rows = rows.withColumns({"extension": ext, "language": language, "is_source": source, "is_manifest": F.lower(name).isin(*MANIFESTS)}).where("is_source or is_manifest")
    held = F.when(F.col("is_source"), text)
    return rows.withColumn("line_count", F.when(F.col("is_source"), F.length(held) - F.length(F.replace(held, F.lit("\n"), F.lit(""))) + 1)).withColumn("content", held)


def discover(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """The source files and manifests below a folder (``catalogued``), by Spark's binary reader; beyond ``most_files`` files of any kind, an error.

    That reader passes over empty files and over names that begin with a dot or an underscore (``__init__.py`` too); where those count, give
    ``catalogued`` a listing of your own.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most_files is not None and raw.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"more than {most_files} files below {root}")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return catalogued(raw.select("path", F.substr("path", F.lit(len(base) + 2)).alias("relative_path"), F.col("length").alias("size_bytes"), "content"))


# a repository of the documents and pages: their texts as files of many kinds and places
VIEWS["repository_files"] = View(
    ("documents", "pages"),
    """
SELECT concat(CASE length(t) % 5 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN 'src/' WHEN 2 THEN 'pkg/build/' WHEN 3 THEN '' ELSE 'a/b.c/d/' END, 'd', CAST(doc_id AS STRING),
 CASE length(t) % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.MJS' WHEN 3 THEN '.txt' WHEN 4 THEN '' WHEN 5 THEN '.test.go' ELSE '.jsx' END) AS relative_path, t AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM {documents}) d
UNION ALL SELECT concat('web/p', CAST(page_id AS STRING), '/', CASE length(t) % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'manage.py' ELSE 'bundle.js' END), t FROM (SELECT page_id, coalesce(html, '') AS t FROM {pages}) p""".strip(),
)
_KNOWN = ", ".join(f"('{e}', '{x}')" for e, x in LANGUAGES.items())
_CATALOG = f"""SELECT relative_path, size_bytes, extension, language, is_source, is_manifest, CASE WHEN is_source THEN lines END AS line_count FROM (
 SELECT f.*, k.language, size_bytes <= {MOST_BYTES} AND k.language IS NOT NULL AND NOT (length(text) >= {MINIFIED_CHARS} AND position(chr(10) IN substr(text, 1, {MINIFIED_CHARS})) = 0) AS is_source FROM (
  SELECT relative_path, text, octet_length(encode(text)) AS size_bytes, lower(regexp_extract(relative_path, '[^/][.]([^./]+)$', 1)) AS extension, len(string_split(text, chr(10))) AS lines, regexp_extract(relative_path, '[^/]+$') IN {MANIFESTS} AS is_manifest
  FROM {{repository_files}} WHERE NOT regexp_matches(relative_path, '(^|/)({"|".join(EXCLUDED).replace(".", "[.]")})/')) f LEFT JOIN (VALUES {_KNOWN}) k(e, language) ON k.e = f.extension) x WHERE is_source OR is_manifest"""


@native("s_01_discovery", "repository_files", sql=_CATALOG)
def s_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a repository is read: its source files and manifests."""
    files = view(spark, sf_dir, "repository_files").select("relative_path", F.octet_length("text").alias("size_bytes"), F.encode("text", "UTF-8").alias("content"))
    return catalogued(files).drop("content")


def python_facts(source: str) -> Iterator[tuple[str, str, str, int, int, str]]:
    """(kind, name, detail, line, end line, enclosing function) of each import, definition, call and assignment."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", type(e).__name__, str(getattr(e, "msg", e)), getattr(e, "lineno", 1) or 1, getattr(e, "lineno", 1) or 1, ""
        return

    def text(node: ast.AST | None) -> str:
        return ast.unparse(node) if node is not None else ""

    def visit(node: ast.AST, scope: str) -> Iterator[tuple[str, str, str, int, int, str]]:
        for x in ast.iter_child_nodes(node):
            here, at = scope, (getattr(x, "lineno", 0), getattr(x, "end_lineno", 0))
            if isinstance(x, ast.Import):
                for a in x.names:
                    yield "import", a.name, a.asname or "", *at, scope
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    yield "from", "." * x.level + (x.module or ""), a.name, *at, scope
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                here = f"{scope}.{x.name}".lstrip(".")
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                yield kind, here, ",".join(a.arg for a in x.args.args) if kind == "function" else "", *at, scope
                for deco in x.decorator_list:
                    yield "decorator", text(deco), x.name, deco.lineno, deco.end_lineno or deco.lineno, here
                if not x.name.startswith("_"):
                    yield "export", x.name, kind, *at, scope
            elif isinstance(x, ast.Call):
                yield "call", text(x.func), ast.unparse(x), *at, scope
            elif isinstance(x, ast.Assign | ast.AnnAssign):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    yield "assign", text(t), text(x.value), *at, scope
            yield from visit(x, here)

    yield from visit(tree, "")


def facts(files: DataFrame, parse: Callable[[str], Iterator[tuple]] = python_facts) -> DataFrame:
    """A row a fact from (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in parse(c or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, FACTS)


# rules over facts: a relation in, findings out


def _finding(df: DataFrame, rule: str, severity: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "path", "line", F.col("detail").alias("snippet"))


def security_findings(f: DataFrame) -> DataFrame:
    """The Python syntax rules as filters over facts, one union."""
    call = f.where("kind = 'call'")
    name, detail = F.col("name"), F.col("detail")
    dynamic = ~detail.rlike(r"""^[\w.]+\((['"])[^'"]*\1""")
    arms = [
        _finding(f.where("kind = 'assign' and name like '%DEBUG' and detail = 'True'").union(call.where(name.endswith("run") & detail.contains("debug=True"))), "SEC-PY-002", "HIGH"),
        _finding(call.where((name.startswith("subprocess.") & detail.contains("shell=True") & dynamic) | ((name == "os.system") & dynamic)), "SEC-PY-003", "CRITICAL"),
        _finding(call.where(name.isin("eval", "exec", "builtins.eval", "builtins.exec")), "SEC-PY-004", "CRITICAL"),
        _finding(call.where(name.rlike(r"(^|\.)(execute|executemany|raw)$") & detail.rlike(r"(?i)\b(select|insert|update|delete)\b") & detail.rlike(r"""\(f['"]|['"] [%+] |\.format\(""")), "SEC-PY-005", "HIGH"),
        _finding(call.where(name.isin("hashlib.md5", "hashlib.sha1", "md5", "sha1") & ~detail.contains("usedforsecurity=False")), "SEC-PY-006", "MEDIUM"),
        _finding(f.where("kind = 'assign' and name in ('CORS_ALLOW_ALL_ORIGINS', 'CORS_ORIGIN_ALLOW_ALL') and detail = 'True'").union(call.where(name.endswith("CORS") & detail.contains("'*'"))), "SEC-PY-007", "HIGH"),
        _finding(f.where("kind = 'decorator' and name like '%csrf_exempt'"), "SEC-PY-008", "HIGH"),
    ]
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out


# taint inside a function

TAINT = "path string, function string, sink string, category string, line int, state string, trace string"


def taint_paths(source: str) -> list[tuple[str, str, str, int, str, str]]:
    """(function, sink, category, line, state, trace) of each source that reaches a sink inside one function."""
    return [(name, h.sink, h.category, h.line, "TAINTED", ">".join(h.trace)) for name, h in flow.findings(python.read(source))]


def taint(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *h) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in taint_paths(c or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 2
            names = ["path", "function", "sink", "category", "line", "state", "trace"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, TAINT)
