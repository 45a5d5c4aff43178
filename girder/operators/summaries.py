"""Taint summaries of functions as a fixpoint over a lattice, and paths across functions on top of them.

The relations are those that resolution and the analysis of single functions give:

- ``call_flows`` (caller, from_param, callee, to_param, clean, returned): a parameter goes into a call; ``clean``: the categories
  (bits) that it is made safe for on the way, over all sites of that call those that each of them makes safe;
  ``returned``: whether what the call gives is returned.
- ``own_flows`` (fn, param, sinks, returns): the categories of sinks that a parameter meets in the function itself, and those
  for which it comes back from it unsafe.
- ``source_calls`` (fn, callee, to_param, clean): a source of the function goes into a call.

A summary is a row (fn, param, mask): four bits of sinks, four of returns. Masks of callers are or-sums of the masks of what they
call, so a mask only grows. A round joins the rows that have grown, with the new bits alone, with the calls that
lead to them; what is new there is the next round's input. Rounds are bounded by the bits of a mask times the longest way
between functions; what is held is a row a function and parameter, never one for each source or sink that reaches it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import native, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View

#: Categories of sinks, a bit each, and the calls that a path may go through.
CATEGORIES = ("SQL", "COMMAND", "DOM", "EVAL")
ALL = (1 << len(CATEGORIES)) - 1
MOST_CALLS = 5

VIEWS["call_flows"] = View(
    ("lineitem",),
    """
SELECT caller, from_param, callee, to_param, CAST(bit_and(clean) AS INT) AS clean, max(returned) AS returned FROM (
  SELECT a.l_partkey AS caller, CAST(a.l_linenumber % 2 AS INT) AS from_param, b.l_partkey AS callee, CAST(b.l_linenumber % 2 AS INT) AS to_param, b.l_quantity > 40 AS returned,
         CASE WHEN a.l_returnflag = 'R' THEN 1 ELSE 0 END + CASE WHEN a.l_linestatus = 'F' THEN 2 ELSE 0 END + CASE WHEN a.l_discount > 0.05 THEN 4 ELSE 0 END + CASE WHEN a.l_tax > 0.04 THEN 8 ELSE 0 END AS clean
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey) s
GROUP BY caller, from_param, callee, to_param""".strip(),
)
VIEWS["own_flows"] = View(
    ("part",),
    """
SELECT p_partkey AS fn, CAST(length(p_name) % 2 AS INT) AS param,
       CASE WHEN p_size > 2 THEN 0 WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'PROMO' THEN 2 WHEN p_type = 'STANDARD' THEN 4 ELSE 8 END AS sinks, CASE WHEN p_size % 4 = 0 THEN 15 WHEN p_size % 4 = 1 THEN 5 ELSE 0 END AS returns
FROM {part} WHERE p_size <= 2 OR p_size % 4 <= 1""".strip(),
)
VIEWS["source_calls"] = View(("call_flows", "part"), "SELECT caller AS fn, callee, to_param, CAST(bit_and(clean) AS INT) AS clean FROM {call_flows} JOIN {part} ON p_partkey = caller WHERE p_size >= 48 GROUP BY caller, callee, to_param")


def _kept(clean: Column, returned: Column) -> Column:
    """What a call lets through of its callee's mask."""
    unsafe = F.lit(ALL).bitwiseAND(F.bitwise_not(clean))
    return unsafe.bitwiseOR(F.when(returned, F.shiftleft(unsafe, len(CATEGORIES))).otherwise(0))


def summaries(calls: DataFrame, own: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The summaries (fn, param, mask), and (fn, param, bit, depth, sink, next_fn, next_param): the shortest way from a parameter to a sink of each category.

    ``depth`` counts the calls on the way, ``sink`` is the smallest function among those at that distance, ``next_fn``, ``next_param``
    the first step towards it. ``most``: calls after which no further way is looked for; none by default.
    """
    scratch = Scratch(calls.sparkSession, "summaries")
    bits = [1 << i for i in range(len(CATEGORIES))]
    way = "struct<sink:bigint,next_fn:bigint,next_param:int>"
    steps = calls.select(F.col("callee").alias("to_fn"), F.col("to_param").alias("to"), F.col("caller").alias("fn"), F.col("from_param").cast("int").alias("param"), _kept(F.col("clean"), F.coalesce("returned", F.lit(False))).alias("kept"))
    steps = scratch.save(steps, "steps")
    mask = F.col("sinks").bitwiseOR(F.shiftleft("returns", len(CATEGORIES)))
    front = own.groupBy(F.col("fn").cast("long").alias("fn"), F.col("param").cast("int").alias("param")).agg(F.bit_or(mask.cast("int")).alias("mask")).where("mask <> 0")
    here = F.struct(F.col("fn").alias("sink"), F.lit(None).cast("long").alias("next_fn"), F.lit(None).cast("int").alias("next_param")).cast(way)
    front = scratch.save(front.select("fn", "param", "mask", *[F.when(F.col("mask").bitwiseAND(b) > 0, here).alias(f"w{b}") for b in bits]), "front-0")
    known, ways = scratch.save(front.select("fn", "param", "mask"), "known-0"), []
    for k in count(0):
        each = F.filter(F.array(*[F.struct(F.lit(b).alias("bit"), F.col(f"w{b}").alias("way")) for b in bits]), lambda x: x["way"].isNotNull())
        ways.append(front.select("fn", "param", F.explode(each).alias("x")).select("fn", "param", "x.bit", F.lit(k).alias("depth"), "x.way.*"))
        if k == most:
            break
        sent = front.select(F.col("fn").alias("to_fn"), F.col("param").alias("to"), F.col("mask").alias("new"), *[f"w{b}" for b in bits])
        met = steps.join(sent, ["to_fn", "to"]).withColumn("new", F.col("new").bitwiseAND(F.col("kept"))).where("new <> 0")
        onward = {b: F.when(F.col("new").bitwiseAND(b) > 0, F.struct(F.col(f"w{b}.sink").alias("sink"), F.col("to_fn").alias("next_fn"), F.col("to").alias("next_param"))) for b in bits}
        grown = met.groupBy("fn", "param").agg(F.bit_or("new").alias("new"), *[F.min(w).alias(f"w{b}") for b, w in onward.items()])
        grown = grown.join(known, ["fn", "param"], "left").withColumn("new", F.col("new").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0))))).where("new <> 0")
        front = scratch.save(grown.select("fn", "param", F.col("new").alias("mask"), *[F.when(F.col("new").bitwiseAND(b) > 0, F.col(f"w{b}")).alias(f"w{b}") for b in bits]), f"front-{k + 1}")
        if not front.take(1):
            break
        known = scratch.save(known.unionByName(front.select("fn", "param", "mask")).groupBy("fn", "param").agg(F.bit_or("mask").alias("mask")), f"known-{k + 1}")
    out = ways[0]
    for part in ways[1:]:
        out = out.unionByName(part)
    return known, out


def findings_across(sources: DataFrame, ways: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """(source_fn, callee, sink_fn, category, depth): a source goes into a call that leads on to a sink it is not safe for, over ``most`` calls at most. One row for each source's function, call and category."""
    hit = sources.join(ways, (F.col("callee") == ways["fn"]) & (F.col("to_param") == ways["param"])).where(F.col("clean").bitwiseAND(F.col("bit")) == 0)
    hit = hit.select(sources["fn"].alias("source_fn"), "callee", "sink", "bit", (F.col("depth") + 1).alias("depth")).where(F.col("depth") <= most)
    category = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (1 << i, c)]), F.col("bit"))
    best = hit.groupBy("source_fn", "callee", "bit").agg(F.min(F.struct("depth", "sink")).alias("x"))
    return best.select("source_fn", "callee", F.col("x.sink").alias("sink_fn"), category.alias("category"), F.col("x.depth").cast("int").alias("depth"))


_KEPT = f"(({ALL} & ~clean) | CASE WHEN returned THEN ({ALL} & ~clean) << {len(CATEGORIES)} ELSE 0 END)"
_FIXPOINT = f"""WITH RECURSIVE own AS (SELECT fn, param, b.bit FROM (SELECT fn, param, sinks | (returns << {len(CATEGORIES)}) AS m FROM {{own_flows}}) o, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit) b WHERE (m & b.bit) > 0),
r AS (SELECT fn, param, bit FROM own UNION SELECT c.caller, c.from_param, r.bit FROM r JOIN {{call_flows}} c ON c.callee = r.fn AND c.to_param = r.param WHERE ({_KEPT} & r.bit) > 0)
SELECT fn, param, CAST(sum(bit) AS INTEGER) AS mask FROM r GROUP BY fn, param"""


@native("t_13_summary_fixpoint", "own_flows", "call_flows", sql=_FIXPOINT)
def t_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each parameter: categories of sinks that it reaches, and for which it comes back unsafe."""
    return summaries(view(spark, sf_dir, "call_flows"), view(spark, sf_dir, "own_flows"))[0]


_PATHS = f"""WITH RECURSIVE own AS (SELECT fn, param, b.bit FROM {{own_flows}} o, (SELECT unnest([1, 2, 4, 8]) AS bit) b WHERE (sinks & b.bit) > 0),
r AS (SELECT fn, param, bit, fn AS sink, 1 AS depth FROM own UNION SELECT c.caller, c.from_param, r.bit, r.sink, r.depth + 1 FROM r JOIN {{call_flows}} c ON c.callee = r.fn AND c.to_param = r.param WHERE ({_KEPT} & r.bit) > 0 AND r.depth < {MOST_CALLS}),
near AS (SELECT fn, param, bit, min(depth) AS depth FROM r GROUP BY fn, param, bit),
w AS (SELECT r.fn, r.param, r.bit, r.depth, min(r.sink) AS sink FROM r JOIN near n ON n.fn = r.fn AND n.param = r.param AND n.bit = r.bit AND n.depth = r.depth GROUP BY ALL),
h AS (SELECT s.fn AS source_fn, s.callee, w.bit, min(w.depth) AS depth FROM {{source_calls}} s JOIN w ON w.fn = s.callee AND w.param = s.to_param WHERE (s.clean & w.bit) = 0 GROUP BY ALL)
SELECT h.source_fn, h.callee, min(w.sink) AS sink_fn, CASE h.bit WHEN 1 THEN 'SQL' WHEN 2 THEN 'COMMAND' WHEN 4 THEN 'DOM' ELSE 'EVAL' END AS category, CAST(h.depth AS INTEGER) AS depth
FROM h JOIN {{source_calls}} s ON s.fn = h.source_fn AND s.callee = h.callee AND (s.clean & h.bit) = 0 JOIN w ON w.fn = s.callee AND w.param = s.to_param AND w.bit = h.bit AND w.depth = h.depth GROUP BY h.source_fn, h.callee, h.bit, h.depth"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest sink of each category for each source that goes into a call."""
    _, ways = summaries(view(spark, sf_dir, "call_flows"), view(spark, sf_dir, "own_flows"), MOST_CALLS - 1)
    return findings_across(view(spark, sf_dir, "source_calls"), ways)


@native("sec_js_009_dom_interprocedural", "own_flows", "call_flows", "source_calls", sql=f"SELECT sink_fn, count(*) AS paths, min(depth) AS nearest FROM ({_PATHS}) a WHERE category = 'DOM' GROUP BY sink_fn")
def sec_js_009(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at the function of the sink, with the paths that lead to it."""
    return nearest(spark, sf_dir).where(F.col("category") == "DOM").groupBy("sink_fn").agg(F.count("*").alias("paths"), F.min("depth").alias("nearest"))


@native("j_14_path_sink_file", "own_flows", "call_flows", "source_calls", "functions", sql=f"SELECT DISTINCT a.file_id AS source_file, b.file_id AS sink_file, p.category FROM ({_PATHS}) p JOIN {{functions}} a ON a.fn = p.source_fn JOIN {{functions}} b ON b.fn = p.sink_fn")
def j_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that paths lead between, by category."""
    f = view(spark, sf_dir, "functions").select("fn", "file_id")
    met = nearest(spark, sf_dir).join(f.select(F.col("fn").alias("source_fn"), F.col("file_id").alias("source_file")), "source_fn").join(f.select(F.col("fn").alias("sink_fn"), F.col("file_id").alias("sink_file")), "sink_fn")
    return met.select("source_file", "sink_file", "category").distinct()
