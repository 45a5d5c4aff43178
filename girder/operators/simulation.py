"""Refactoring proposals simulated on the component graph, all of them in one plan.

A proposal removes and adds edges. Cycles of the graph are found once. A proposal loses those that hold one of its removed edges; new ones
must hold an added edge, so they are searched from those alone, over nodes that lead back to the edge's beginning. No cycle leaves a strong
component of the graph with the added edges of all proposals, so a proposal takes no more of the graph than the components of its added
edges. Couplings change by the proposal's own edges only: deltas are sums over these.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.graph import HOPS, simple_cycles, strong_components, within
from girder.plans.operator import native, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View

KEY = ["p", "u", "v"]


def _rotated(path: Column) -> Column:
    """A cycle's nodes from the smallest on."""
    i = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, i, F.size(path)), F.slice(path, F.lit(1), i - 1))


def _instability(ca: Column, ce: Column) -> Column:
    return F.when(ca + ce == 0, F.lit(0.0)).otherwise(ce.cast("double") / (ca + ce))


def simulate(edges: DataFrame, mutations: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """(p, cycles_before, cycles_after, new_cycles, target_eliminated, sdp_violations, status) for each proposal.

    edges (a, b); mutations (p, action ADD or REMOVE, a, b); affected (p, node): the components a proposal is about, by default
    those that its edges name. Removing an edge that is not there and adding one that is change nothing.
    """
    scratch = Scratch(edges.sparkSession, "simulation")
    e = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    named = mutations.where("a is not null and b is not null and a <> b")
    add = scratch.save(named.where("upper(action) = 'ADD'").select("p", "a", "b").distinct(), "add-asked")
    # an edge that is removed and added is there afterwards
    removed = scratch.save(named.where("upper(action) = 'REMOVE'").select("p", "a", "b").distinct().join(e, ["a", "b"], "left_semi").join(add, ["p", "a", "b"], "left_anti").select("p", "a", "b"), "removed")
    added = scratch.save(add.join(e, ["a", "b"], "left_anti").select("p", "a", "b"), "added")
    proposals = mutations.select("p").distinct()
    if affected is None:
        affected = named.select("p", F.explode(F.array("a", "b")).alias("node"))
    affected = scratch.save(affected.select("p", "node").distinct(), "affected")

    # no proposal has a cycle that leaves a strong component of the graph with the added edges of all
    every = scratch.save(e.union(added.select("a", "b")).distinct(), "every")
    parts = scratch.save(strong_components(every, every.select(F.col("a").alias("id")).union(every.select("b")).distinct()), "parts")
    inner = scratch.save(within(e, parts), "inner")
    goal = scratch.save(within(added, parts).select("p", F.col("a").alias("u"), F.col("b").alias("v")), "goal")
    # what a proposal makes of the components of its added edges
    about = goal.join(parts.withColumnRenamed("id", "u"), "u").select("p", "scc").distinct()
    own = inner.join(parts.withColumnRenamed("id", "a"), "a").join(about, "scc").select("p", "a", "b").join(removed, ["p", "a", "b"], "left_anti")
    own = scratch.save(own.union(goal), "own")

    # nodes that lead to the beginning u of an added edge (u, v)
    toward = own.select("p", F.col("b").alias("x"), F.col("a").alias("next"))
    new = back = scratch.save(goal.select(*KEY, F.col("u").alias("x")), "back-0")
    for k in count(1):
        reached = new
        for _ in range(HOPS):
            reached = reached.union(reached.join(toward, ["p", "x"]).select(*KEY, F.col("next").alias("x"))).distinct()
        new = scratch.save(reached.join(back, [*KEY, "x"], "left_anti"), f"back-{k}")
        if not new.take(1):
            break
        back = back.union(new)
    closing = own.select("p", F.col("b").alias("u"), F.col("a").alias("x"), F.lit(True).alias("closes"))
    ends = scratch.save(back.where("x <> u").join(closing, ["p", "u", "x"], "left").na.fill(False, ["closes"]).select(*KEY, "x", "closes"), "ends")
    onward = own.withColumnRenamed("b", "next").join(ends.withColumnRenamed("x", "next"), ["p", "next"]).where("a <> u and next <> v")
    onward = scratch.save(onward.select(*KEY, F.col("a").alias("x"), "next", "closes"), "onward")
    paths = scratch.save(ends.where("x = v").select(*KEY, F.array("u", "v").alias("path"), "x", "closes"), "paths-0")
    found = None
    for k in count(1):
        closed = paths.where("closes").select("p", _rotated(F.col("path")).alias("cycle"))
        found = closed if found is None else found.union(closed)
        grown = paths.drop("closes").join(onward, [*KEY, "x"]).where("not array_contains(path, next)")
        paths = scratch.save(grown.select(*KEY, F.concat("path", F.array("next")).alias("path"), F.col("next").alias("x"), "closes"), f"paths-{k}")
        if not paths.take(1):
            break
    fresh = scratch.save(found.distinct().withColumn("id", F.xxhash64("cycle")), "fresh")

    kind = e.schema["a"].dataType.simpleString()
    cycles = scratch.save(simple_cycles(inner, "simulation-cycles", parts).select(F.split("cycle", ">").cast(f"array<{kind}>").alias("cycle")).withColumn("id", F.xxhash64("cycle")), "cycles")
    total = cycles.count()
    turns = cycles.select("id", F.explode(F.arrays_zip(F.col("cycle").alias("a"), F.concat(F.slice("cycle", 2, F.size("cycle")), F.slice("cycle", 1, 1)).alias("b"))).alias("x")).select("id", "x.a", "x.b")
    lost = scratch.save(turns.join(removed, ["a", "b"]).select("p", "id").distinct(), "lost")
    touching = cycles.select("id", F.explode("cycle").alias("node")).join(affected, "node").select("p", "id").distinct()
    touched = touching.join(lost.withColumn("gone", F.lit(1)), ["p", "id"], "left").groupBy("p").agg(F.count("*").alias("touched"), F.count(F.when(F.col("gone").isNull(), 1)).alias("left"))
    hit = fresh.select("p", "id", F.explode("cycle").alias("node")).join(affected, ["p", "node"]).select("p", "id").distinct().groupBy("p").agg(F.count("*").alias("hit"))

    sdp = couplings(e, added, removed)
    worse = added.join(sdp.select("p", F.col("node").alias("a"), F.col("after").alias("ia")), ["p", "a"]).join(sdp.select("p", F.col("node").alias("b"), F.col("after").alias("ib")), ["p", "b"]).where("ia < ib").groupBy("p").agg(F.count("*").alias("sdp"))
    out = proposals
    for part in (lost.groupBy("p").agg(F.count("*").alias("lost")), fresh.groupBy("p").agg(F.count("*").alias("fresh")), touched, hit, worse):
        out = out.join(part, "p", "left")
    out = out.na.fill(0)
    after = F.lit(total) - F.col("lost") + F.col("fresh")
    gone = ((F.col("touched") > 0) & (F.col("left") + F.col("hit") == 0)) | ((F.lit(total) > 0) & (after < total))
    fine = (F.col("fresh") == 0) & (gone | ((F.lit(total) == 0) & (after == 0)))
    return out.select("p", F.lit(total).cast("long").alias("cycles_before"), after.cast("long").alias("cycles_after"), F.col("fresh").alias("new_cycles"), gone.alias("target_eliminated"), F.col("sdp").alias("sdp_violations"), F.when(fine, "VERIFIED_SIMULATION").otherwise("UNVERIFIED_SIMULATION").alias("status"))


def couplings(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(p, node, delta_ca, delta_ce, before, after): what each proposal does to the couplings and instability of the nodes that its edges name."""
    signed = added.withColumn("s", F.lit(1)).union(removed.withColumn("s", F.lit(-1)))
    deltas = signed.select("p", F.col("b").alias("node"), F.col("s").alias("ca"), F.lit(0).alias("ce")).union(signed.select("p", F.col("a").alias("node"), F.lit(0), "s"))
    deltas = deltas.groupBy("p", "node").agg(F.sum("ca").alias("delta_ca"), F.sum("ce").alias("delta_ce"))
    ca = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("ca"))
    ce = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("ce"))
    both = deltas.join(ca, "node", "left").join(ce, "node", "left").na.fill(0, ["ca", "ce"])
    before, after = _instability(F.col("ca"), F.col("ce")), _instability(F.col("ca") + F.col("delta_ca"), F.col("ce") + F.col("delta_ce"))
    return both.select("p", "node", "delta_ca", "delta_ce", before.alias("before"), after.alias("after"))


# A proposal a package: what its fifth module imports is dropped where that is an earlier module, and its largest module is to import its smallest one.
VIEWS["proposals"] = View(
    ("edges", "modules"),
    """
SELECT m.component AS p, 'REMOVE' AS action, e.src AS a, e.tgt AS b FROM {edges} e JOIN {modules} m ON m.id = e.src WHERE e.tgt < e.src AND e.src = m.component * 20 + 5
UNION ALL SELECT component, 'ADD', max_by(id, loc * 100000000 + id), min_by(id, loc * 100000000 + id) FROM {modules} GROUP BY component HAVING count(*) > 1""".strip(),
)


def _oracle() -> str:
    """Each proposal's graph written out, all its cycles enumerated within the packages that it names, which hold all that can change."""
    walk = """SELECT p, src AS a, [src, tgt] AS path, tgt AS fin FROM {g} WHERE tgt > src UNION ALL SELECT w.p, w.a, list_append(w.path, e.tgt), e.tgt FROM {w} w JOIN {g} e ON w.p = e.p AND w.fin = e.src WHERE e.tgt > w.a AND NOT list_contains(w.path, e.tgt)"""
    return f"""WITH RECURSIVE own AS (SELECT a.component AS p, e.src, e.tgt FROM {{edges}} e JOIN {{modules}} a ON a.id = e.src JOIN {{modules}} b ON b.id = e.tgt WHERE a.component = b.component),
add_ AS (SELECT p, a AS src, b AS tgt FROM {{proposals}} WHERE action = 'ADD'), rem AS (SELECT p, a AS src, b AS tgt FROM {{proposals}} WHERE action = 'REMOVE' EXCEPT SELECT * FROM add_),
changed AS (SELECT p, src, tgt FROM own EXCEPT SELECT * FROM rem UNION SELECT p, src, tgt FROM add_),
w0 AS ({walk.format(g="own", w="w0")}), w1 AS ({walk.format(g="changed", w="w1")}),
c0 AS (SELECT w0.p, path FROM w0 JOIN own e ON e.p = w0.p AND w0.fin = e.src AND e.tgt = w0.a), c1 AS (SELECT w1.p, path FROM w1 JOIN changed e ON e.p = w1.p AND w1.fin = e.src AND e.tgt = w1.a),
aff AS (SELECT DISTINCT p, unnest([a, b]) AS node FROM {{proposals}}), ids AS (SELECT DISTINCT p FROM {{proposals}}),
every AS (SELECT p, src, tgt FROM (SELECT src, tgt FROM {{edges}}) e, ids EXCEPT SELECT * FROM rem UNION SELECT * FROM add_),
inst AS (SELECT p, node, coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)) AS i FROM (SELECT p, node, (SELECT count(*) FROM every x WHERE x.p = aff.p AND x.tgt = aff.node) AS ca, (SELECT count(*) FROM every x WHERE x.p = aff.p AND x.src = aff.node) AS ce FROM aff) z),
t AS (SELECT ids.p, (SELECT count(*) FROM c0) AS cycles_before, (SELECT count(*) FROM c0 WHERE c0.p <> ids.p) + (SELECT count(*) FROM c1 WHERE c1.p = ids.p) AS cycles_after,
  (SELECT count(*) FROM (SELECT path FROM c1 WHERE c1.p = ids.p EXCEPT SELECT path FROM c0 WHERE c0.p = ids.p) n) AS new_cycles,
  (SELECT count(*) FROM c0 WHERE c0.p = ids.p AND EXISTS (SELECT 1 FROM aff WHERE aff.p = ids.p AND list_contains(c0.path, aff.node))) AS touched,
  (SELECT count(*) FROM c1 WHERE c1.p = ids.p AND EXISTS (SELECT 1 FROM aff WHERE aff.p = ids.p AND list_contains(c1.path, aff.node))) AS remaining,
  (SELECT count(*) FROM add_ x JOIN inst s ON s.p = x.p AND s.node = x.src JOIN inst g ON g.p = x.p AND g.node = x.tgt WHERE x.p = ids.p AND s.i < g.i AND NOT EXISTS (SELECT 1 FROM {{edges}} o WHERE o.src = x.src AND o.tgt = x.tgt)) AS sdp_violations FROM ids),
v AS (SELECT *, (touched > 0 AND remaining = 0) OR (cycles_before > 0 AND cycles_after < cycles_before) AS target_eliminated FROM t)
SELECT p, cycles_before, cycles_after, new_cycles, target_eliminated, sdp_violations, CASE WHEN new_cycles = 0 AND (target_eliminated OR (cycles_before = 0 AND cycles_after = 0)) THEN 'VERIFIED_SIMULATION' ELSE 'UNVERIFIED_SIMULATION' END AS status FROM v"""


@native("g_14_refactoring_simulation", "edges", "modules", "proposals", sql=_oracle())
def g_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a proposal for each package."""
    return simulate(view(spark, sf_dir, "edges").select(F.col("src").alias("a"), F.col("tgt").alias("b")), view(spark, sf_dir, "proposals"))
