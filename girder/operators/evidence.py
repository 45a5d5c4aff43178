"""Properties of expressions, evidence chains, routing of symbols, and trends of components."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.operators.findings import deductions
from girder.plans.operator import Dialect, native, operator, view
from girder.plans.views import VIEWS, View

#: What an expression starts with, or has in it, for which properties. A range takes one of each of two lists.
TYPE_CASTS, TYPED = ("int(", "float(", "bool(", "Number(", "parseInt(", "parseFloat("), ("VALIDATED_TYPE", "TYPE_COERCED", "SQL_SAFE")
RANGES, RANGED = ((">=", "<=", ">", "<"), ("and", "&&")), ("VALIDATED_RANGE",)
PROPERTIES = (
    ((" in ", ".includes(", ".has("), ("VALIDATED_ENUM",)),
    (("shlex.quote(", "quote("), ("COMMAND_SAFE", "SHELL_QUOTED")),
    (("html.escape(", "escape(", "DOMPurify.sanitize("), ("HTML_SAFE", "HTML_ESCAPED")),
    (("urllib.parse.quote(", "encodeURIComponent("), ("URL_SAFE",)),
    (("psycopg2.sql.Literal(", "sql.Literal("), ("SQL_SAFE",)),
    (("os.path.basename(", "path.basename(", "os.path.abspath("), ("PATH_SAFE", "PATH_NORMALIZED")),
)
#: Properties of which any makes a value safe for a sink.
SAFE = (
    ("SQL_EXECUTE", ("VALIDATED_TYPE", "TYPE_COERCED", "SQL_SAFE")),
    ("COMMAND_EXECUTE", ("VALIDATED_TYPE", "TYPE_COERCED", "COMMAND_SAFE", "SHELL_QUOTED")),
    ("DOM_INJECTION", ("VALIDATED_TYPE", "TYPE_COERCED", "HTML_SAFE", "HTML_ESCAPED")),
    ("CODE_EVAL", ("VALIDATED_TYPE", "TYPE_COERCED", "VALIDATED_FORMAT", "VALIDATED_ENUM")),
    ("FILE_PATH", ("VALIDATED_TYPE", "TYPE_COERCED", "PATH_SAFE", "PATH_NORMALIZED", "VALIDATED_ENUM")),
)
#: Properties that hold where branches meet if they hold on any of them, and the objects that a name may stand for.
UNSAFE, MOST_OBJECTS = ("UNTRUSTED", "UNKNOWN"), 4

# a line of an order is a branch, and the order the place where its branches meet: what the line's value went through, from within, what it
# may stand for, and what a test of it showed
VIEWS["branches"] = View(
    ("lineitem",),
    """
SELECT l_orderkey AS point, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS branch,
       concat('p', CAST(l_partkey AS STRING)) AS part, concat('s', CAST(l_suppkey AS STRING)) AS supplier, l_returnflag = 'R' AS escaped, l_returnflag = 'A' AS quoted, l_tax > 0.06 AS cast_type, l_linestatus = 'F' AS based,
       l_discount > 0.08 AS listed, l_quantity > 45 AS ranged, CASE WHEN l_tax > 0.06 THEN 'int' WHEN l_tax > 0.02 THEN 'str' END AS refined_type, l_quantity > 20 AS is_numeric
FROM {lineitem}""".strip(),
)
_WRITTEN = """
SELECT *, concat(CASE WHEN based THEN 'os.path.basename(' ELSE '' END, CASE WHEN cast_type THEN ' int(' ELSE '' END, CASE WHEN escaped THEN 'html.escape(' WHEN quoted THEN 'shlex.quote(' ELSE '' END, part,
 CASE WHEN escaped OR quoted THEN ')' ELSE '' END, CASE WHEN cast_type THEN ')' ELSE '' END, CASE WHEN based THEN ')' ELSE '' END, CASE WHEN listed THEN ' in ALLOWED' ELSE '' END, CASE WHEN ranged THEN ' > 1 and true' ELSE '' END) AS expr
FROM {branches}"""
#: The properties of a branch by what its value went through, for the oracles: a cast counts only where nothing is around it.
_HELD = """SELECT b.*, list_sort(list_filter(['UNTRUSTED', CASE WHEN cast_type AND NOT based THEN 'VALIDATED_TYPE' END, CASE WHEN cast_type AND NOT based THEN 'TYPE_COERCED' END, CASE WHEN cast_type AND NOT based THEN 'SQL_SAFE' END, CASE WHEN ranged THEN 'VALIDATED_RANGE' END, CASE WHEN listed THEN 'VALIDATED_ENUM' END,
 CASE WHEN quoted THEN 'COMMAND_SAFE' END, CASE WHEN quoted THEN 'SHELL_QUOTED' END, CASE WHEN escaped THEN 'HTML_SAFE' END, CASE WHEN escaped THEN 'HTML_ESCAPED' END, CASE WHEN based THEN 'PATH_SAFE' END, CASE WHEN based THEN 'PATH_NORMALIZED' END], lambda x: x IS NOT NULL)) AS properties FROM {branches} b"""


def properties(expr: Column | str = "expr", before: Column | None = None) -> Column:
    """The sorted set of properties that an expression's text shows, with those held before; what came in is untrusted. A null text shows none."""
    text = F.trim(F.col(expr) if isinstance(expr, str) else expr)
    some = lambda words: reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    tests = [(reduce(or_, [F.startswith(text, F.lit(w)) for w in TYPE_CASTS]), TYPED), (some(RANGES[0]) & some(RANGES[1]), RANGED), *((some(words), names) for words, names in PROPERTIES)]
    held = [F.when(test, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for test, names in tests]
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit("UNTRUSTED")) if before is None else before, *held)))


def safe_for(held: Column) -> Column:
    """(sink, safe) for each kind of sink: whether any of the properties is held that make a value safe for it."""
    return F.array(*[F.struct(F.lit(k).alias("sink"), F.arrays_overlap(held, F.array(*map(F.lit, ps))).alias("safe")) for k, ps in SAFE])


def met_properties(states: DataFrame) -> DataFrame:
    """(point, property) where the branches (point, properties) meet: an unsafe one on any of them stays, all others must hold on all."""
    n = states.groupBy("point").agg(F.count("*").alias("n"))
    held = states.select("point", F.explode(F.array_distinct("properties")).alias("property")).groupBy("point", "property").agg(F.count("*").alias("k"))
    return held.join(n, "point").where(F.col("property").isin(*UNSAFE) | (F.col("k") == F.col("n"))).select("point", "property")


def met_objects(objects: DataFrame, most: int = MOST_OBJECTS) -> DataFrame:
    """(point, name, objects, unknown, ambiguous, truncated) of rows (point, name, object, unknown, ambiguous, truncated): the first of the united objects, in order.

    A branch whose name stands for nothing known has a row with a null object. The order of merges does not matter: the first few of a
    union are the first few of the parts' first few, so no point's objects meet in one task before all but these are gone.
    """
    flags = objects.groupBy("point", "name").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("unknown", "ambiguous", "truncated")])
    place = F.row_number().over(W.partitionBy("point", "name").orderBy("object"))
    first = objects.where("object is not null").select("point", "name", "object").distinct().withColumn("place", place).where(F.col("place") <= most + 1)
    few = first.groupBy("point", "name").agg(F.array_sort(F.collect_list("object")).alias("all"))
    size = F.coalesce(F.size("all"), F.lit(0))
    kept = F.coalesce(F.slice("all", 1, most), F.array().cast("array<string>"))
    return flags.join(few, ["point", "name"], "left").select("point", "name", kept.alias("objects"), "unknown", (F.col("ambiguous") | (F.least(size, F.lit(most)) > 1)).alias("ambiguous"), (F.col("truncated") | (size > most)).alias("truncated"))


def met_facts(states: DataFrame, facts: DataFrame) -> DataFrame:
    """(point, name, refined_type, is_numeric): of the first branch of a point, the facts that every other one confirms.

    ``states``: (point, branch), a row a branch; ``facts``: (point, branch, name, refined_type, is_numeric). A branch confirms a fact with one on the
    same name and type, or if both say that it is a number in digits.
    """
    n = states.groupBy("point").agg(F.count("*").alias("n"), F.min("branch").alias("branch"))
    first = facts.join(n, ["point", "branch"]).select("point", "name", "refined_type", "is_numeric", "n").distinct()
    said = facts.select("point", "name", F.col("branch").alias("b"), F.col("refined_type").alias("t"), F.col("is_numeric").alias("d")).distinct()
    met = first.join(said, ["point", "name"]).where((F.col("t") == F.col("refined_type")) | (F.col("d") & F.col("is_numeric")))
    keys = ["point", "name", "refined_type", "is_numeric", "n"]
    own = first.where("n = 1").select(*keys[:-1])
    return own.unionByName(met.where("n > 1").select(*keys, "b").distinct().groupBy(*keys).agg(F.count("*").alias("k")).where("k = n").select(*keys[:-1])).distinct()


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_WRITTEN, branches=view(spark, sf_dir, "branches"))


@native("p_27_security_properties", "branches", sql=f"SELECT point, branch, array_to_string(properties, ',') AS properties FROM ({_HELD}) h")
def p_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branches(spark, sf_dir).select("point", "branch", F.array_join(properties(), ",").alias("properties"))


@native("p_28_sink_safety", "branches", sql=f"SELECT h.point, h.branch, s.sink, bool_or(list_contains(h.properties, s.p)) AS safe FROM ({_HELD}) h, (VALUES " + ", ".join(f"('{k}', '{p}')" for k, ps in SAFE for p in ps) + ") s(sink, p) GROUP BY h.point, h.branch, s.sink")
def p_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a value is safe for each kind of sink."""
    return _branches(spark, sf_dir).select("point", "branch", F.explode(safe_for(properties())).alias("s")).select("point", "branch", "s.*")


_MET = f"""WITH h AS ({_HELD}), o AS (SELECT point, list_sort(list_distinct(list_concat(list(part), list(supplier)))) AS l FROM {{branches}} GROUP BY point)
SELECT point, 'property' AS kind, p AS value FROM (SELECT point, unnest(properties) AS p FROM h) x GROUP BY point, p HAVING p IN ('UNTRUSTED', 'UNKNOWN') OR count(*) = (SELECT count(*) FROM {{branches}} b WHERE b.point = x.point)
UNION ALL SELECT point, 'object', unnest(l[1:{MOST_OBJECTS}]) FROM o UNION ALL SELECT point, 'points-to', 'ambiguous' FROM o WHERE len(l) > 1 UNION ALL SELECT point, 'points-to', 'truncated' FROM o WHERE len(l) > {MOST_OBJECTS}
UNION ALL SELECT f.point, 'fact', f.refined_type FROM {{branches}} f WHERE f.branch = 1 AND f.refined_type IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM {{branches}} s WHERE s.point = f.point AND s.branch > 1 AND NOT coalesce(s.refined_type = f.refined_type OR (s.refined_type IS NOT NULL AND s.is_numeric AND f.is_numeric), false))"""


@native("u_07_refinement_join", "branches", sql=_MET)
def u_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where branches meet: properties that stay, the objects that are left of the united ones, and facts that all branches confirm."""
    b = _branches(spark, sf_dir)
    held = met_properties(b.select("point", properties().alias("properties"))).select("point", F.lit("property").alias("kind"), F.col("property").alias("value"))
    none = [F.lit(False).alias(c) for c in ("unknown", "ambiguous", "truncated")]
    o = met_objects(b.select("point", F.lit("v").alias("name"), F.explode(F.array("part", "supplier")).alias("object"), *none))
    flags = F.array_compact(F.array(F.when(F.col("ambiguous"), "ambiguous"), F.when(F.col("truncated"), "truncated")))
    facts = met_facts(b.select("point", "branch"), b.where("refined_type is not null").select("point", "branch", F.lit("v").alias("name"), "refined_type", "is_numeric"))
    parts = [o.select("point", F.lit("object").alias("kind"), F.explode("objects").alias("value")), o.select("point", F.lit("points-to").alias("kind"), F.explode(flags).alias("value")), facts.select("point", F.lit("fact").alias("kind"), F.col("refined_type").alias("value"))]
    return reduce(DataFrame.unionByName, parts, held)


# evidence chains

_CHAIN = """
SELECT conv_id, sha256(concat('{"conditions":[', (SELECT string_agg(concat('"', role, '"'), ',' ORDER BY lo) FROM (SELECT role, min(turn) AS lo FROM {turns} u WHERE u.conv_id = t.conv_id AND u.turn < 10 GROUP BY role) r), '],"steps":[',
 string_agg(concat('{"index":', CAST(turn AS VARCHAR), ',"role":"', role, '","text":"', sha256(text), '"}'), ',' ORDER BY turn), ']}')) AS chain_hash FROM {turns} t WHERE turn < 10 GROUP BY conv_id"""


@native("p_25_evidence_chain", "turns", sql=_CHAIN)
def p_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten steps of a chain, its distinct conditions in order, and the hash of both as canonical JSON."""
    t = view(spark, sf_dir, "turns").where("turn < 10").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))
    steps = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chain = t.groupBy("conv_id").agg(steps.alias("s"))
    said = F.transform("s", lambda x: F.concat(F.lit('{"index":'), x["turn"].cast("string"), F.lit(',"role":"'), x["role"], F.lit('","text":"'), x["text"], F.lit('"}')))
    conditions = F.transform(F.array_distinct(F.transform("s", lambda x: x["role"])), lambda r: F.concat(F.lit('"'), r, F.lit('"')))
    return chain.select("conv_id", F.sha2(F.concat(F.lit('{"conditions":['), F.array_join(conditions, ","), F.lit('],"steps":['), F.array_join(said, ","), F.lit("]}")), 256).alias("chain_hash"))


# routing of symbols to repositories

VIEWS["symbols"] = View(("part",), "SELECT p_partkey AS id, replace(p_name, ' ', '.') AS module, CASE WHEN p_partkey % 9 = 0 THEN concat('r', CAST(p_partkey % 4 AS STRING)) END AS hint FROM {part}")
VIEWS["package_routing"] = View(
    ("symbols",),
    "SELECT prefix, min(repo) AS repo FROM (SELECT split_part(module, '.', 1) AS prefix, concat('r', CAST(id % 7 AS STRING)) AS repo FROM {symbols} WHERE id % 5 = 0 UNION ALL SELECT concat(split_part(module, '.', 1), '.', split_part(module, '.', 2)), concat('q', CAST(id % 3 AS STRING)) FROM {symbols} WHERE id % 11 = 0) x GROUP BY prefix",
)


def routed(d: Dialect) -> str:
    """A hint comes first, then the longest registered prefix of the module's path (an equi-join over its prefixes), then none."""
    prefixes = "explode(transform(sequence(1, size(split(module, '[.]'))), i -> array_join(slice(split(module, '[.]'), 1, i), '.')))" if d.name == "spark" else "unnest(list_transform(range(1, len(string_split(module, '.')) + 1), lambda i: array_to_string(string_split(module, '.')[1:i], '.')))"
    return f"""
SELECT s.id, s.module, coalesce(s.hint, r.repo) AS repo, CASE WHEN s.hint IS NOT NULL THEN 'HINT' WHEN r.repo IS NOT NULL THEN 'PREFIX' ELSE 'GLOBAL' END AS how
FROM {{symbols}} s LEFT JOIN (SELECT x.id, max_by(p.repo, length(p.prefix)) AS repo FROM (SELECT id, {prefixes} AS prefix FROM {{symbols}}) x JOIN {{package_routing}} p ON p.prefix = x.prefix GROUP BY x.id) r ON r.id = s.id"""


@operator("j_18_longest_prefix", "symbols", "package_routing")
def j_18(d: Dialect) -> str:
    return routed(d)


@operator("l_10_contract_scoping", "symbols", "package_routing")
def l_10(d: Dialect) -> str:
    """Symbols of other repositories by the repository that resolves them; those that none does are blocked."""
    return f"SELECT coalesce(repo, 'none') AS repo, CASE WHEN how = 'GLOBAL' THEN 'BLOCKED' ELSE 'RESOLVED' END AS state, count(*) AS symbols FROM ({routed(d)}) r GROUP BY coalesce(repo, 'none'), CASE WHEN how = 'GLOBAL' THEN 'BLOCKED' ELSE 'RESOLVED' END"


# trends


@operator("w_03_health_delta", "findings")
def w_03(d: Dialect) -> str:
    """The health score of a repository's last snapshot less that of its first."""
    snap = "(SELECT *, concat(repo_id, '|', day) AS snap FROM {findings}) f"
    scores = f"SELECT k.snap, k.repo_id, k.day, k.category, 100.0 - CAST(coalesce(p.points, 0) AS DOUBLE) AS score FROM (SELECT DISTINCT concat(repo_id, '|', day) AS snap, repo_id, day, category FROM {{findings}}) k LEFT JOIN (SELECT snap, category, sum(points) AS points FROM ({deductions('snap', snap)}) x GROUP BY snap, category) p ON p.snap = k.snap AND p.category = k.category"
    overall = f"SELECT repo_id, day, round(0.55 * coalesce(max(CASE WHEN category = 'SECURITY' THEN greatest(0.0, score) END), 100.0) + 0.45 * coalesce(max(CASE WHEN category = 'ARCHITECTURE' THEN greatest(0.0, score) END), 100.0), 2) AS overall FROM ({scores}) s GROUP BY repo_id, day"
    return f"SELECT repo_id, round(max_by(overall, day) - min_by(overall, day), 2) AS delta FROM ({overall}) o GROUP BY repo_id"


VIEWS["component_snapshots"] = View(
    ("lineitem", "supplier", "orders", "customer"),
    """
SELECT snapshot, component, CAST(round(CAST(sum(ce) AS DOUBLE) / (sum(ca) + sum(ce)), 4) AS DOUBLE) AS instability FROM (
  SELECT snapshot, src AS component, count(DISTINCT tgt) AS ce, 0 AS ca FROM (SELECT DISTINCT substr(CAST(o_orderdate AS STRING), 1, 4) AS snapshot, s_nationkey AS src, c_nationkey AS tgt FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey) a GROUP BY snapshot, src
  UNION ALL SELECT snapshot, tgt, 0, count(DISTINCT src) FROM (SELECT DISTINCT substr(CAST(o_orderdate AS STRING), 1, 4) AS snapshot, s_nationkey AS src, c_nationkey AS tgt FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey) b GROUP BY snapshot, tgt) u
GROUP BY snapshot, component""".strip(),
)


@operator("j_15_component_drift", "component_snapshots")
def j_15(d: Dialect) -> str:
    """Instability in the latest snapshot against the earliest; a component without a baseline has not drifted."""
    return """
SELECT l.component, round(l.instability - coalesce(e.instability, l.instability), 3) AS drift
FROM (SELECT c.* FROM {component_snapshots} c JOIN (SELECT max(snapshot) AS s FROM {component_snapshots}) m ON m.s = c.snapshot) l LEFT JOIN (SELECT c.* FROM {component_snapshots} c JOIN (SELECT min(snapshot) AS s FROM {component_snapshots}) m ON m.s = c.snapshot) e ON e.component = l.component"""


@operator("o_07_top_drift", "component_snapshots")
def o_07(d: Dialect) -> str:
    return f"SELECT component, drift FROM ({j_15.text(d)}) x ORDER BY abs(drift) DESC, component LIMIT 15"
