"""Graphs over edge lists: degrees, components, coupling, closures, waves, cycles, layers.

Closures and components are semi-naive loops over DataFrames: each round joins only the pairs that the
round before found, drops those already known, and is written to the shared scratch folder so that its lineage
stays short. The driver holds nothing but row counts.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import Dialect, native, operator, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View

@operator("a_03_fan_in_out", "edges", "modules")
def a_03(d: Dialect) -> str:
    return """
SELECT m.id, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in FROM {modules} m
LEFT JOIN (SELECT src, count(DISTINCT tgt) AS n FROM {edges} GROUP BY src) o ON o.src = m.id LEFT JOIN (SELECT tgt, count(DISTINCT src) AS n FROM {edges} GROUP BY tgt) i ON i.tgt = m.id"""


@operator("a_02_coupling_metrics", "edges", "modules")
def a_02(d: Dialect) -> str:
    return f"""
SELECT count(*) AS modules, CAST(sum(fan_out) AS BIGINT) AS local_edges, round(CAST(sum(fan_out) AS DOUBLE) / (count(*) * (count(*) - 1)), 4) AS density, round(CAST(avg(fan_in) AS DOUBLE), 2) AS mean_fan_in, round(CAST(avg(fan_out) AS DOUBLE), 2) AS mean_fan_out, max(fan_out) AS max_fan_out
FROM ({a_03.text(d)}) f"""


@operator("a_08_component_rollup", "modules")
def a_08(d: Dialect) -> str:
    return f"SELECT component, CAST(sum(loc) AS BIGINT) AS total_loc, count(*) AS file_count, {d.joined('path')} AS files FROM {{modules}} GROUP BY component"


@operator("a_09_component_edge_weight", "edges", "modules")
def a_09(d: Dialect) -> str:
    return f"""
SELECT a.component AS source, b.component AS target, count(*) AS weight, {d.joined("concat(lpad(CAST(e.src AS STRING), 12, '0'), '>', lpad(CAST(e.tgt AS STRING), 12, '0'))")} AS file_edges
FROM {{edges}} e JOIN {{modules}} a ON a.id = e.src JOIN {{modules}} b ON b.id = e.tgt WHERE a.component <> b.component GROUP BY a.component, b.component"""


@operator("a_10_instability", "component_edges", "modules")
def a_10(d: Dialect) -> str:
    return """
SELECT c.component, coalesce(a.n, 0) AS ca, coalesce(e.n, 0) AS ce, CASE WHEN coalesce(a.n, 0) + coalesce(e.n, 0) = 0 THEN 0.0 ELSE round(CAST(coalesce(e.n, 0) AS DOUBLE) / (coalesce(a.n, 0) + coalesce(e.n, 0)), 4) END AS instability
FROM (SELECT DISTINCT component FROM {modules}) c LEFT JOIN (SELECT tgt, count(DISTINCT src) AS n FROM {component_edges} GROUP BY tgt) a ON a.tgt = c.component
LEFT JOIN (SELECT src, count(DISTINCT tgt) AS n FROM {component_edges} GROUP BY src) e ON e.src = c.component"""


@operator("g_02_component_graph", "component_edges", "modules")
def g_02(d: Dialect) -> str:
    return f"SELECT e.src, e.tgt, e.weight, s.instability AS src_i, t.instability AS tgt_i FROM {{component_edges}} e JOIN ({a_10.text(d)}) s ON s.component = e.src JOIN ({a_10.text(d)}) t ON t.component = e.tgt"


@operator("o_04_graph_order", "edges")
def o_04(d: Dialect) -> str:
    return "SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY tgt, n) AS place FROM {edges}"


#: Tiers in the order in which they are tried, with the path words that name them, and the prohibited directions.
TIERS = (
    ("PRESENTATION", "presentation presentations presenter presenters api controller controllers endpoint endpoints route routes view views cli reporting frontend ui"),
    ("INFRASTRUCTURE", "infrastructure infra db database persistence repository repositories adapter adapters storage client clients"),
    ("DOMAIN", "domain domains model models entity entities rule rules core"),
    ("APPLICATION", "application app usecase usecases handler handlers service services use_case use_cases workflow orchestrator engine"),
    ("UTILITY", "util utils common helper helpers config shared"),
)
PROHIBITED = (("INFRASTRUCTURE", "PRESENTATION"), ("INFRASTRUCTURE", "APPLICATION"), ("DOMAIN", "PRESENTATION"), ("DOMAIN", "INFRASTRUCTURE"), ("UTILITY", "PRESENTATION"), ("UTILITY", "APPLICATION"))


def tiers(d: Dialect, rel: str, path: str = "path", key: str = "path") -> str:
    """(key, tier): segments of a path from last to first, tiers in declared order; the first word that names a segment decides, none is guessed."""
    words = ", ".join(f"('{w}', '{t}', {i})" for i, (t, ws) in enumerate(TIERS) for w in ws.split())
    return f"""
SELECT {key}, min_by(tier, rnk) AS tier FROM (
  SELECT s.{key}, k.tier, (100 - s.pos) * 10 + k.ord AS rnk FROM (SELECT {key}, s.pos, s.x FROM {rel} {d.each(d.split(f"lower(replace({path}, '-', '_'))", "/"), "s")}) s JOIN (SELECT * FROM (VALUES {words}) AS k(word, tier, ord)) k ON s.x = k.word) m
GROUP BY {key}"""


@operator("p_05_component_name", "files")
def p_05(d: Dialect) -> str:
    parts = d.split("path", "/")
    first, second = d.at(parts, "1"), d.at(parts, "2")
    n = "length(path) - length(replace(path, '/', ''))"
    return f"SELECT path, CASE WHEN {n} = 0 THEN 'root' WHEN {n} = 1 THEN lower(replace({first}, '-', '_')) ELSE concat(lower(replace({first}, '-', '_')), '.', lower(replace({second}, '-', '_'))) END AS component FROM {{files}}"


@operator("g_15_tier_inference", "files")
def g_15(d: Dialect) -> str:
    return tiers(d, "{files}")


@operator("g_16_layer_inversion", "edges", "modules")
def g_16(d: Dialect) -> str:
    """Edges from a tier into one that it may not know; both tiers must be known."""
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PROHIBITED)
    known = tiers(d, "{modules}", "path", "id")
    return f"SELECT e.src, e.tgt, a.tier AS a, b.tier AS b FROM {{edges}} e JOIN ({known}) a ON a.id = e.src JOIN ({known}) b ON b.id = e.tgt JOIN (SELECT * FROM (VALUES {pairs}) AS p(x, y)) p ON a.tier = p.x AND b.tier = p.y"


@operator("arc_005_layer_inversion", "edges", "modules")
def arc_005(d: Dialect) -> str:
    return f"SELECT concat('ARC-005:', CAST(src AS STRING), '>', CAST(tgt AS STRING)) AS finding, 'HIGH' AS severity FROM ({g_16.text(d)}) v"


#: The thresholds of the architecture rules.
FAN_OUT = 10
GOD_SMALL, GOD_LARGE = {"loc": 500, "fan_out": 8, "fan_in": 5}, {"loc": 800, "fan_out": 10}
STABLE, UNSTABLE, LEAST_CA = 0.30, 0.70, 2
BETWEENNESS, LEAST_COMPONENTS, LEAST_FILES = 0.35, 5, 2


@operator("arc_002_coupling", "edges", "modules")
def arc_002(d: Dialect) -> str:
    return f"SELECT id, fan_out, 'MEDIUM' AS severity FROM ({a_03.text(d)}) f WHERE fan_out > {FAN_OUT}"


@operator("arc_003_god_module", "edges", "modules")
def arc_003(d: Dialect) -> str:
    small = " AND ".join(f"{k} > {v}" for k, v in GOD_SMALL.items())
    large = " AND ".join(f"{k} > {v}" for k, v in GOD_LARGE.items())
    return f"""
SELECT *, CASE WHEN {small} THEN 'condition_1' ELSE 'condition_2' END AS matched
FROM (SELECT f.id, m.loc, f.fan_in, f.fan_out FROM ({a_03.text(d)}) f JOIN {{modules}} m ON m.id = f.id) x WHERE ({small}) OR ({large})"""


@operator("arc_007_sdp_violation", "component_edges", "modules")
def arc_007(d: Dialect) -> str:
    """Edges from a stable component, on which others rest, to an unstable one."""
    return f"""
SELECT e.src, e.tgt, s.ca AS src_ca, s.instability AS src_i, t.instability AS tgt_i
FROM {{component_edges}} e JOIN ({a_10.text(d)}) s ON s.component = e.src JOIN ({a_10.text(d)}) t ON t.component = e.tgt
WHERE s.instability <= {STABLE} AND s.ca >= {LEAST_CA} AND t.instability >= {UNSTABLE}"""


@operator("g_18_contract_graph", "calls", "functions")
def g_18(d: Dialect) -> str:
    return "SELECT f.file_id, count(*) AS edges, count(DISTINCT c.callee) AS callees FROM {calls} c JOIN {functions} f ON f.fn = c.caller GROUP BY f.file_id"


@operator("g_19_neighbourhood", "component_edges")
def g_19(d: Dialect) -> str:
    return "SELECT src AS component, tgt AS neighbour FROM {component_edges} WHERE src = 1 UNION SELECT tgt, src FROM {component_edges} WHERE tgt = 1"


# closures


def closure(edges: DataFrame, seeds: DataFrame | None = None, name: str = "closure") -> DataFrame:
    """(a, b): every pair with a path from a to b in edges (a, b); from the seeds (a) only, if given."""
    scratch = Scratch(edges.sparkSession, name)
    e = scratch.save(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    new = scratch.save(e if seeds is None else e.join(seeds.select("a").distinct(), "a", "left_semi"), "new-0")
    known, hop = new, e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for k in count(1):
        step = new.join(hop, "b").select("a", F.col("c").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        new = scratch.save(step, f"new-{k}")
        if not new.take(1):
            break
        known = scratch.save(known.union(new), f"known-{k}")
    return known


def components(edges: DataFrame, nodes: DataFrame, name: str = "wcc") -> DataFrame:
    """(id, component): the smallest node of each weakly connected component, by alternating star contraction."""
    scratch = Scratch(edges.sparkSession, name)
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "e-0")
    mark, k = None, 0
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        k += 1
        e = scratch.save(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), f"e-{k}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return nodes.join(e.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").select(F.col("src").alias("a"), F.col("tgt").alias("b"))


@native("g_04_weak_components", "edges", "modules", sql="WITH RECURSIVE both_ways AS (SELECT src AS a, tgt AS b FROM {edges} UNION SELECT tgt, src FROM {edges}), r AS (SELECT id AS a, id AS b FROM {modules} UNION SELECT r.a, w.b FROM r JOIN both_ways w ON r.b = w.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def g_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_edges(spark, sf_dir), view(spark, sf_dir, "modules").select("id"))


@native("g_05_strong_components", "edges", "modules", sql="WITH RECURSIVE r AS (SELECT src AS a, tgt AS b FROM {edges} UNION SELECT r.a, e.tgt FROM r JOIN {edges} e ON r.b = e.src) SELECT m.id, least(m.id, coalesce(min(x.b), m.id)) AS scc FROM {modules} m LEFT JOIN r x ON x.a = m.id AND EXISTS (SELECT 1 FROM r y WHERE y.a = x.b AND y.b = x.a) GROUP BY m.id")
def g_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(_edges(spark, sf_dir), view(spark, sf_dir, "modules").select("id"))


#: Steps along edges in one job.
HOPS = 3


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, scc): the smallest node that is reachable both ways.

    In each round nodes without an edge in or out are trimmed, and each of the rest takes the smallest node that reaches it as its
    colour; the nodes that reach their colour's own node within the colour are a component, and go. Tables hold nodes and
    edges, never pairs of nodes that reach each other.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    rest = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges-0")
    found: DataFrame | None = None
    k = 0
    while rest.take(1):
        k += 1
        live = rest.select("a").distinct().intersect(rest.select(F.col("b").alias("a")).distinct())
        rest = scratch.save(rest.join(live, "a", "left_semi").join(live.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"), f"trimmed-{k}")
        if not rest.take(1):
            break
        # the smallest node that reaches each node: only what changed is passed on
        colour = scratch.save(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().withColumn("c", F.col("id")), f"colour-{k}-0")
        new, r = colour, 0
        while new.take(1):
            r += 1
            sent = new
            for _ in range(HOPS):  # what changed is passed on several times before anything is written
                passed = sent.join(rest, sent["id"] == rest["a"]).select(F.col("b").alias("id"), "c")
                sent = sent.union(passed).groupBy("id").agg(F.min("c").alias("c"))
            met = colour.join(sent.withColumnRenamed("c", "n"), "id", "left")
            merged = scratch.save(met.select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")), f"colour-{k}-{r}")
            colour, new = merged.select("id", "c"), merged.where("moved").select("id", "c")
        inside = rest.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
        inside = scratch.save(inside, f"inside-{k}")
        # backwards from each colour's own node
        new = member = scratch.save(colour.where("id = c"), f"member-{k}-0")
        r = 0
        while new.take(1):
            r += 1
            back = new
            for _ in range(HOPS):
                back = back.union(inside.join(back.select(F.col("id").alias("b"), "c"), "b").select(F.col("a").alias("id"), "c")).distinct()
            new = scratch.save(back.join(member, ["id", "c"], "left_anti"), f"member-{k}-{r}")
            member = member.union(new)
        member = scratch.save(member, f"members-{k}")
        found = member if found is None else found.union(member)
        gone = member.select("id")
        rest = rest.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        rest = scratch.save(rest, f"edges-{k}")
    if found is None:
        return nodes.select("id", F.col("id").alias("scc"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("c", "id").alias("scc"))


def _component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "component_edges").select(F.col("src").alias("a"), F.col("tgt").alias("b"))


def component_cycles(edges: DataFrame) -> DataFrame:
    """(scc, members) of strong components of two or more."""
    parts = strong_components(edges, edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct())
    return parts.groupBy("scc").agg(F.count("*").alias("members")).where("members >= 2")


# every import between packages that third parts make, whichever way it goes
VIEWS["component_imports"] = View(
    ("lineitem", "modules"),
    """
SELECT a.component AS src, b.component AS tgt, count(*) AS weight
FROM {lineitem} x JOIN {lineitem} y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN {modules} a ON a.id = x.l_partkey JOIN {modules} b ON b.id = y.l_partkey
WHERE x.l_linenumber = 3 AND x.l_returnflag = 'R' AND x.l_linestatus = 'F' AND a.component <> b.component GROUP BY a.component, b.component""".strip(),
)


@native("arc_006_component_cycle", "component_imports", sql="WITH RECURSIVE r AS (SELECT src AS a, tgt AS b FROM {component_imports} UNION SELECT r.a, e.tgt FROM r JOIN {component_imports} e ON r.b = e.src), s AS (SELECT x.a AS id, min(x.b) AS scc FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT scc, count(*) AS members FROM s GROUP BY scc HAVING count(*) >= 2")
def arc_006(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of components, over imports both to earlier packages and to later ones."""
    return component_cycles(view(spark, sf_dir, "component_imports").select(F.col("src").alias("a"), F.col("tgt").alias("b")))


@native("g_08_reverse_closure", "edges", sql="WITH RECURSIVE r AS (SELECT tgt AS a, src AS b FROM {edges} WHERE tgt IN (3, 5) UNION SELECT r.a, e.src FROM r JOIN {edges} e ON r.b = e.tgt) SELECT DISTINCT b AS affected FROM r")
def g_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _edges(spark, sf_dir).select(F.col("b").alias("a"), F.col("a").alias("b"))
    seeds = spark.createDataFrame([(3,), (5,)], "a long")
    return closure(back, seeds, "reverse").select(F.col("b").alias("affected")).distinct()


@native(
    "g_09_impact_set",
    "edges",
    "modules",
    sql="WITH RECURSIVE r AS (SELECT tgt AS a, src AS b FROM {edges} WHERE tgt IN (3, 5) UNION SELECT r.a, e.src FROM r JOIN {edges} e ON r.b = e.tgt) SELECT m.id, CASE WHEN m.id IN (3, 5) THEN 'DIRECT' WHEN m.id IN (SELECT b FROM r) THEN 'DEPENDENCY' ELSE 'REUSABLE' END AS reason FROM {modules} m",
)
def g_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = g_08(spark, sf_dir)
    m = view(spark, sf_dir, "modules").select("id").join(hit, F.col("id") == F.col("affected"), "left")
    return m.select("id", F.when(F.col("id").isin(3, 5), "DIRECT").when(F.col("affected").isNotNull(), "DEPENDENCY").otherwise("REUSABLE").alias("reason"))


@native("g_11_transitive_dependencies", "repo_dag", sql="WITH RECURSIVE r AS (SELECT repo AS a, needs AS b FROM {repo_dag} UNION SELECT r.a, e.needs FROM r JOIN {repo_dag} e ON r.b = e.repo) SELECT a AS repo, count(*) AS n_dependencies FROM r GROUP BY a")
def g_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    dag = view(spark, sf_dir, "repo_dag").select(F.col("repo").alias("a"), F.col("needs").alias("b"))
    return closure(dag, name="dag").groupBy(F.col("a").alias("repo")).agg(F.count("*").alias("n_dependencies"))


@native("g_10_dag_validate", "edges", sql="WITH RECURSIVE r AS (SELECT src AS a, tgt AS b FROM {edges} UNION SELECT r.a, e.tgt FROM r JOIN {edges} e ON r.b = e.src) SELECT a AS node FROM r WHERE a = b")
def g_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lie on a cycle: a valid DAG has none."""
    e = _edges(spark, sf_dir)
    parts = strong_components(e, e.select(F.col("a").alias("id")).union(e.select("b")).distinct())
    large = parts.groupBy("scc").count().where("count > 1").select("scc")
    return parts.join(large, "scc", "left_semi").select(F.col("id").alias("node")).union(e.where("a = b").select("a")).distinct()


def waves(dag: DataFrame, nodes: DataFrame, name: str = "waves") -> DataFrame:
    """(id, wave): the longest distance from a node without dependencies; rounds peel the finished nodes off (dag: id, needs)."""
    scratch = Scratch(dag.sparkSession, name)
    rest = scratch.save(nodes.select("id").distinct(), "rest-0")
    dag = scratch.save(dag.select("id", "needs").distinct(), "dag")
    done: DataFrame | None = None
    k = 0
    while rest.take(1):
        waiting = dag.join(rest.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct()
        ready = scratch.save(rest.join(waiting, "id", "left_anti").withColumn("wave", F.lit(k)), f"ready-{k}")
        if not ready.take(1):
            raise ValueError("the graph has a cycle")
        done = ready if done is None else done.union(ready)
        rest = scratch.save(rest.join(ready.select("id"), "id", "left_anti"), f"rest-{k + 1}")
        k += 1
    return done if done is not None else nodes.select("id").withColumn("wave", F.lit(0))


_WAVES = "WITH RECURSIVE w AS (SELECT id, 0 AS wave FROM {repositories} WHERE id NOT IN (SELECT repo FROM {repo_dag}) UNION SELECT d.repo, w.wave + 1 FROM w JOIN {repo_dag} d ON d.needs = w.id) SELECT id, max(wave) AS wave FROM w GROUP BY id"


@native("g_12_execution_waves", "repo_dag", "repositories", sql=_WAVES)
def g_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(view(spark, sf_dir, "repo_dag").select(F.col("repo").alias("id"), "needs"), view(spark, sf_dir, "repositories"))


@native("y_07_wave_sizes", "repo_dag", "repositories", sql=f"SELECT wave, count(*) AS n FROM ({_WAVES}) x GROUP BY wave")
def y_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_12(spark, sf_dir).groupBy("wave").agg(F.count("*").alias("n"))


@native("g_07_longest_path", "repo_dag", "repositories", sql=f"SELECT max(wave) AS depth FROM ({_WAVES}) x")
def g_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_12(spark, sf_dir).agg(F.max("wave").alias("depth"))


@native("arc_004_deep_chain", "repo_dag", "repositories", sql=f"SELECT max(wave) AS depth, 'LOW' AS severity FROM ({_WAVES}) x HAVING max(wave) > 5")
def arc_004(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_07(spark, sf_dir).where("depth > 5").withColumn("severity", F.lit("LOW"))


def returning(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, v): the nodes v > a from which a can be reached over nodes that are larger than a."""
    back = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    new = known = scratch.save(edges.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("v")), "back-0")
    for k in count(1):
        step = new
        for _ in range(HOPS):
            step = step.union(step.join(back, "v").where("u > a").select("a", F.col("u").alias("v"))).distinct()
        new = scratch.save(step.join(known, ["a", "v"], "left_anti"), f"back-{k}")
        if not new.take(1):
            return known
        known = scratch.save(known.union(new), f"returning-{k}")


def within(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges (a, b, and what else they have) with both ends in one of the parts (id, scc)."""
    e = edges.join(parts.select(F.col("id").alias("a"), F.col("scc").alias("x")), "a").join(parts.select(F.col("id").alias("b"), F.col("scc").alias("y")), "b")
    return e.where("x = y").select(*edges.columns)


def simple_cycles(edges: DataFrame, name: str = "cycles", parts: DataFrame | None = None) -> DataFrame:
    """(cycle, length): elementary cycles from their smallest node; paths grow by one edge a round and never revisit, until none is open.

    Only edges within a strong component count, or within one of the parts (id, scc) if parts that no cycle leaves are given, and a path from a goes
    on only to nodes that lead back to a over nodes larger than a, so paths that cannot close are not grown: in a layered graph with many
    paths and few cycles the work follows the cycles. A path's end is known to have an edge to a or not, so what is written of the rounds holds the cycles.
    """
    scratch = Scratch(edges.sparkSession, name)
    if parts is None:
        parts = scratch.save(strong_components(edges, edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()), "parts")
    e = scratch.save(within(edges.where("a <> b").select("a", "b").distinct(), parts), "edges")
    closing = e.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("next"), F.lit(True).alias("closes"))
    back = scratch.save(returning(e, scratch).withColumnRenamed("v", "next").join(closing, ["a", "next"], "left").na.fill(False, ["closes"]), "back")
    step = e.select(F.col("a").alias("end"), F.col("b").alias("next"))
    first = e.where("b > a").withColumnRenamed("b", "next").join(back, ["a", "next"])
    paths = scratch.save(first.select("a", F.array("a", "next").alias("path"), F.col("next").alias("end"), "closes"), "paths-2")
    found: DataFrame | None = None
    k = 2
    while found is None or paths.take(1):
        closed = paths.where("closes").select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))
        found = closed if found is None else found.union(closed)
        grown = paths.drop("closes").join(step, "end").where("next > a and not array_contains(path, next)").join(back, ["a", "next"])
        k, paths = k + 1, grown.select("a", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"), "closes")
        paths = scratch.save(paths, f"paths-{k}")
    return found


_CYCLES = "WITH RECURSIVE p AS (SELECT src AS a, [src, tgt] AS path, tgt AS fin FROM {edges} WHERE tgt > src UNION ALL SELECT p.a, list_append(p.path, e.tgt), e.tgt FROM p JOIN {edges} e ON p.fin = e.src WHERE e.tgt > p.a AND NOT list_contains(p.path, e.tgt)) SELECT array_to_string(path, '>') AS cycle, len(path)::INTEGER AS length, path FROM p JOIN {edges} e ON p.fin = e.src AND e.tgt = p.a"


@native("g_03_simple_cycles", "edges", sql=f"SELECT cycle, length FROM ({_CYCLES}) c")
def g_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_cycles(_edges(spark, sf_dir))


@native("arc_001_circular", "edges", sql=f"SELECT DISTINCT array_to_string(list_sort(path), ',') AS members FROM ({_CYCLES}) c")
def arc_001(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding a set of nodes on a cycle."""
    c = simple_cycles(_edges(spark, sf_dir), name="arc001")
    return c.select(F.array_join(F.transform(F.array_sort(F.transform(F.split("cycle", ">"), lambda x: x.cast("int"))), lambda x: x.cast("string")), ",").alias("members")).distinct()


@native("g_17_cycle_breaking", "edges", sql=f"SELECT cycle, path[-1] AS drop_src, path[1] AS drop_tgt FROM ({_CYCLES}) c ORDER BY length, cycle LIMIT 3")
def g_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simple_cycles(_edges(spark, sf_dir), name="breaking").orderBy("length", "cycle").limit(3)
    parts = F.split("cycle", ">")
    return c.select("cycle", F.element_at(parts, -1).cast("long").alias("drop_src"), F.element_at(parts, 1).cast("long").alias("drop_tgt"))


#: Sources of the first batch, and pairs of a source and a node that a later batch is to have.
SOURCES_AT_ONCE, PAIRS_AT_ONCE = 1000, 40_000_000
#: Sources are dealt to batches by ranges of a hash below this.
HASHES = 1 << 30


def betweenness(edges: DataFrame, nodes: DataFrame, name: str = "bc") -> DataFrame:
    """(id, betweenness, in_degree, out_degree), directed, unweighted, normalised.

    Batches of sources: breadth-first levels forward as (source, node, level, paths), then each level's dependencies
    backward from those of the next, so that every step is a join with the edges and nothing holds pairs of pairs. A batch has as many
    sources as the pairs that the one before has met allow, so where ways are short all sources go in a few.
    """
    scratch = Scratch(edges.sparkSession, name)
    e = scratch.save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = scratch.save(nodes.select("id").distinct().withColumn("h", F.pmod(F.xxhash64("id"), F.lit(HASHES))), "nodes")
    n = nodes.count()
    total: DataFrame | None = None
    begun, width, batch = 0, min(HASHES, -(-HASHES * SOURCES_AT_ONCE // max(n, 1))), 0
    while begun < HASHES:
        begin = nodes.where((F.col("h") >= begun) & (F.col("h") < begun + width))
        front = begin.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths"))
        levels = [scratch.save(front, f"level-{batch}-0")]
        while True:
            k = len(levels)
            step = levels[-1].join(e.select(F.col("a").alias("v"), "b"), "v").groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
            known = levels[0].select("s", "v")
            for x in levels[1:]:
                known = known.union(x.select("s", "v"))
            step = scratch.save(step.join(known, ["s", "v"], "left_anti").select("s", "v", F.lit(k).alias("level"), "paths"), f"level-{batch}-{k}")
            if not step.take(1):
                break
            levels.append(step)
        # what each node of a level owes to those of the next is summed up on its way back, before it meets the node's own paths
        later = levels[-1].select("s", "v", (1 / F.col("paths")).alias("y"))
        for k in range(len(levels) - 2, 0, -1):
            back = later.join(e.select("a", F.col("b").alias("v")), "v").groupBy("s", F.col("a").alias("v")).agg(F.sum("y").alias("y"))
            mine = levels[k].join(back, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("y", F.lit(0.0))).alias("x"))
            mine = scratch.save(mine, f"share-{batch}-{k}")
            part = mine.where("x > 0").groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("x"))
            total = part if total is None else total.union(part)
            later = mine.select("s", "v", ((1 + F.col("x")) / F.col("paths")).alias("y"))
        begun, batch = begun + width, batch + 1
        if begun < HASHES:
            pairs = sum(x.count() for x in levels)
            width = max(1, min(HASHES - begun, width * PAIRS_AT_ONCE // max(pairs, 1)))
    share = total.groupBy("id").agg(F.sum("x").alias("x")) if total is not None else nodes.select("id", F.lit(0.0).alias("x"))
    pairs, other = max((n - 1) * (n - 2), 1), max(n - 1, 1)
    out_d, in_d = e.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("i"))
    joined = nodes.join(share, "id", "left").join(out_d, "id", "left").join(in_d, "id", "left")
    zero = F.lit(0.0)
    return joined.select("id", F.round(F.coalesce("x", zero) / pairs, 4).alias("betweenness"), F.round(F.coalesce("i", F.lit(0)) / other, 4).alias("in_degree"), F.round(F.coalesce("o", F.lit(0)) / other, 4).alias("out_degree"))


_BFS = """WITH RECURSIVE walk AS (SELECT src AS s, tgt AS v, 1 AS level, [src, tgt] AS path FROM {component_edges} UNION ALL SELECT w.s, e.tgt, w.level + 1, list_append(w.path, e.tgt) FROM walk w JOIN {component_edges} e ON w.v = e.src WHERE NOT list_contains(w.path, e.tgt) ),
near AS (SELECT s, v, min(level) AS level FROM walk GROUP BY s, v), short AS (SELECT w.* FROM walk w JOIN near n ON w.s = n.s AND w.v = n.v AND w.level = n.level),
total AS (SELECT s, v, count(*) AS paths FROM short GROUP BY s, v), through AS (SELECT s, v, unnest(path[2:-2]) AS mid FROM short),
dep AS (SELECT t.mid AS id, sum(1.0::DOUBLE / total.paths) AS x FROM through t JOIN total ON total.s = t.s AND total.v = t.v GROUP BY t.mid)
SELECT m.id, round(coalesce(x, 0) / ((SELECT count(*) FROM {repositories}) - 1) / ((SELECT count(*) FROM {repositories}) - 2), 4) AS betweenness,
 round((SELECT count(*) FROM {component_edges} e WHERE e.tgt = m.id)::DOUBLE / ((SELECT count(*) FROM {repositories}) - 1), 4) AS in_degree, round((SELECT count(*) FROM {component_edges} e WHERE e.src = m.id)::DOUBLE / ((SELECT count(*) FROM {repositories}) - 1), 4) AS out_degree
FROM {repositories} m LEFT JOIN dep USING (id)"""


@native("g_06_centrality", "component_edges", "repositories", sql=_BFS)
def g_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betweenness(_component_edges(spark, sf_dir), view(spark, sf_dir, "repositories"))


def central_components(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(component, betweenness, file_count) of components that many shortest paths pass. files: (component) of each file."""
    sizes = files.groupBy("component").agg(F.count("*").alias("file_count"))
    central = betweenness(edges, sizes.select(F.col("component").alias("id")), name="arc009").where(F.col("betweenness") >= BETWEENNESS)
    enough = sizes.agg(F.count("*").alias("components")).where(F.col("components") >= LEAST_COMPONENTS)
    return central.join(sizes.where(F.col("file_count") >= LEAST_FILES), F.col("id") == F.col("component")).join(F.broadcast(enough), F.lit(True)).select("component", "betweenness", "file_count")  # one row at most


@native(
    "arc_009_centrality",
    "component_edges",
    "repositories",
    "modules",
    sql=f"SELECT id AS component, betweenness, n AS file_count FROM ({_BFS}) c JOIN (SELECT component, count(*) AS n FROM {{modules}} GROUP BY component) f ON f.component = c.id WHERE betweenness >= {BETWEENNESS} AND n >= {LEAST_FILES} AND (SELECT count(*) FROM {{repositories}}) >= {LEAST_COMPONENTS}",
)
def arc_009(spark: SparkSession, sf_dir: str) -> DataFrame:
    return central_components(_component_edges(spark, sf_dir), view(spark, sf_dir, "modules").select("component"))
