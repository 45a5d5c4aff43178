"""The dependency closure kept up to date: what inserted and deleted edges change in it, without computing it again.

Delete and rederive. Pairs with a way over a deleted edge are taken away first: those that end with the edge, then what follows from
them over the old edges. Of these, pairs that still have a way are put back, from pairs that were never doubted on. Then pairs that an inserted edge makes
are added, and what follows from them. Every round works on the pairs that the round before has changed; the closure itself is only
looked up, by joins whose small side is the change.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.operator import native, view
from girder.plans.scratch import Scratch
from girder.plans.views import VIEWS, View

PAIR = ["a", "b"]


def _onward(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, c) for each pair (a, b) and edge (b, c)."""
    return pairs.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()


def _known(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that the closure has: the closure is read once, the few pairs are the side that is built."""
    return closure.join(pairs, PAIR, "left_semi")


def changes(edges: DataFrame, closure: DataFrame, inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Pairs (a, b) that the closure loses and gains, and how many were touched. edges: before the change; closure: its closure."""
    scratch = Scratch(edges.sparkSession, "incremental")
    touched: dict[str, int] = {}
    edges = edges.select(*PAIR).distinct()
    gone = scratch.save(deleted.select(*PAIR).distinct().join(edges, PAIR, "left_semi"), "deleted")
    come = scratch.save(inserted.select(*PAIR).distinct().join(edges, PAIR, "left_anti"), "inserted")
    rest = scratch.save(edges.join(gone, PAIR, "left_anti"), "rest")

    # taken away: a pair that ends with a deleted edge, and what followed from it
    new = scratch.save(gone.union(_onward(closure, gone)).distinct(), "over-0")
    over = new
    for k in count(1):
        if not new.take(1):
            break
        new = scratch.save(_known(closure, _onward(new, edges)).join(over, PAIR, "left_anti"), f"over-{k}")
        over = scratch.save(over.union(new), f"overs-{k}")
    touched["doubted"] = over.count()

    # put back: doubted pairs that the rest still makes, from pairs beyond doubt on
    ahead = F.col("b").alias("c")
    last = over.join(rest.select(F.col("a").alias("x"), F.col("b")), "b")  # a ... x -> b
    still = closure.join(over, PAIR, "left_anti")
    lead = last.select("a", F.col("x").alias("b"), ahead).join(still, PAIR, "left_semi").select("a", F.col("c").alias("b"))
    new = back = scratch.save(over.join(rest, PAIR, "left_semi").union(lead).distinct(), "back-0")
    for k in count(1):
        if not new.take(1):
            break
        new = scratch.save(_onward(new, rest).join(over, PAIR, "left_semi").join(back, PAIR, "left_anti"), f"back-{k}")
        back = scratch.save(back.union(new), f"backs-{k}")
    lost = scratch.save(over.join(back, PAIR, "left_anti"), "lost")
    touched["put_back"] = back.count()

    # added: pairs that end with an inserted edge, and what follows from them
    now = scratch.save(rest.union(come), "edges")
    has = lambda pairs: pairs.join(_known(closure, pairs).join(lost, PAIR, "left_anti"), PAIR, "left_anti")  # noqa: E731  pairs that the closure lacks by now
    held = closure.join(lost, PAIR, "left_anti")
    new = gained = scratch.save(has(scratch.save(come.union(_onward(held, come)).distinct(), "ends")), "gained-0")
    for k in count(1):
        if not new.take(1):
            break
        step = scratch.save(_onward(new, now).join(gained, PAIR, "left_anti"), f"step-{k}")
        new = scratch.save(has(step), f"gained-{k}")
        gained = scratch.save(gained.union(new), f"gains-{k}")
    touched["made"] = gained.count()
    return lost.join(gained, PAIR, "left_anti"), gained.join(lost, PAIR, "left_anti"), touched


def applied(closure: DataFrame, lost: DataFrame, gained: DataFrame) -> DataFrame:
    return closure.select(*PAIR).join(lost, PAIR, "left_anti").union(gained)


# closures as words: a row (a, word, bits) holds which of the 64 nodes from 64 * word on a leads to


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "word").agg(F.bit_or("bits").alias("bits"))


def words(edges: DataFrame, name: str, start: DataFrame | None = None) -> DataFrame:
    """The closure of edges (a, b) from 0 on, in words; with ``start``, words that nodes outside of the edges' beginnings already have.

    Rounds pass on new bits alone.
    """
    scratch = Scratch(edges.sparkSession, name)
    e = scratch.save(edges.select(F.col("a").alias("to"), F.col("b").alias("a")), "edges")  # what a leads to, to leads to as well
    own = edges.select("a", F.floor(F.col("b") / 64).alias("word"), F.expr("shiftleft(1L, int(pmod(b, 64)))").alias("bits"))
    if start is not None:
        own = own.union(e.join(start, "a").select(F.col("to").alias("a"), "word", "bits"))
    new = known = scratch.save(_merged(own), "new-0")
    for k in count(1):
        step = _merged(e.join(new, "a").select(F.col("to").alias("a"), "word", "bits"))
        met = step.join(known.withColumnRenamed("bits", "had"), ["a", "word"], "left")
        new = scratch.save(met.select("a", "word", F.expr("bits & ~coalesce(had, 0L)").alias("bits")).where("bits <> 0"), f"new-{k}")
        if not new.take(1):
            return known
        known = scratch.save(_merged(known.union(new)), f"known-{k}")


def pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of words."""
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("bit")
    return rows.select("a", "word", bit).select("a", (F.col("word") * 64 + F.col("bit")).alias("b"))


def changed_words(old: DataFrame, new: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that the closure (words of the old edges) loses and gains. Only nodes that lead to a changed edge are computed anew."""
    scratch = Scratch(old.sparkSession, "changed-words")
    tails = scratch.save(old.join(new, PAIR, "left_anti").union(new.join(old, PAIR, "left_anti")).select("a").distinct(), "tails")
    back = scratch.save(old.union(new).distinct().select(F.col("b").alias("a"), F.col("a").alias("x")), "back")
    front = hit = tails
    for k in count(1):
        front = scratch.save(back.join(front, "a", "left_semi").select(F.col("x").alias("a")).distinct().join(hit, "a", "left_anti"), f"front-{k}")
        if not front.take(1):
            break
        hit = scratch.save(hit.union(front), f"hit-{k}")
    before = closure.join(hit, "a", "left_semi")
    after = words(new.join(hit, "a", "left_semi"), "changed", closure.join(hit, "a", "left_anti"))
    both = scratch.save(before.withColumnRenamed("bits", "x").join(after.withColumnRenamed("bits", "y"), ["a", "word"], "full"), "both")
    only = lambda x, y: pairs(both.select("a", "word", F.expr(f"coalesce({x}, 0L) & ~coalesce({y}, 0L)").alias("bits")).where("bits <> 0"))
    return only("x", "y"), only("y", "x")


# the same by blocks of 256 nodes that are led to, each found on its own by a task that has the edges

#: Edges of both graphs together that tasks hold whole, 8 bytes each; beyond them rounds go over DataFrames.
MOST_EDGES = 16_000_000
WORDS = 4
#: Pairs in a batch of the result, about.
PAIRS_AT_ONCE = 1 << 16


def into(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) by b: where each node's begin, and what leads to it."""
    order = np.argsort(b, kind="stable")
    return np.searchsorted(b[order], np.arange(n + 1)), a[order]


def led_to(begins: np.ndarray, tails: np.ndarray, bits: np.ndarray, block: int) -> np.ndarray:
    """Sets in ``bits`` (a row a node, a bit a node of the block) what leads to the block's nodes; the rows that are set. Rounds pass on new bits alone."""
    n, size = len(bits), 64 * WORDS
    at = np.arange(block * size, min(n, (block + 1) * size))
    new = np.zeros((len(at), WORDS), np.uint64)
    new[np.arange(len(at)), np.arange(len(at)) // 64] = np.uint64(1) << (np.arange(len(at)) % 64).astype(np.uint64)
    touched = []
    while len(at):
        many = begins[at + 1] - begins[at]
        edge = np.arange(many.sum()) + np.repeat(begins[at] - np.cumsum(many) + many, many)
        to, sent = tails[edge], np.repeat(new, many, axis=0)
        order = np.argsort(to, kind="stable")
        at, first = np.unique(to[order], return_index=True)
        if not len(at):
            break
        new = np.bitwise_or.reduceat(sent[order], first, axis=0) & ~bits[at]
        some = new.any(axis=1)
        at, new = at[some], new[some]
        bits[at] |= new
        touched.append(at)
    return np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)


def changed_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, change): pairs that the closure loses and gains. ``old`` and ``new`` have no more than MOST_EDGES together."""
    spark = old.sparkSession
    ends = [[t.column(c).to_numpy() for c in PAIR] for t in (old.toArrow(), new.toArrow())]
    nodes = np.unique(np.concatenate([x for pair in ends for x in pair]))
    graphs = [into(*(np.searchsorted(nodes, x).astype(np.int32) for x in pair), len(nodes)) for pair in ends]
    sent = spark.sparkContext.broadcast((nodes, graphs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, graphs = sent.value
        both = [np.zeros((len(nodes), WORDS), np.uint64) for _ in graphs]
        for block in (k for b in batches for k in b.column(0).to_pylist()):
            rows = np.unique(np.concatenate([led_to(*g, bits, block) for g, bits in zip(graphs, both, strict=True)]))
            before, after = (bits[rows] for bits in both)
            for change, only in (("LOST", before & ~after), ("GAINED", after & ~before)):
                some = only.any(axis=1)
                source, words = rows[some], only[some]
                step = max(1, PAIRS_AT_ONCE // (64 * WORDS))
                for k in range(0, len(source), step):
                    i, j = np.nonzero(np.unpackbits(words[k : k + step].astype("<u8").view(np.uint8), axis=1, bitorder="little"))
                    a, b = nodes[source[k : k + step][i]], nodes[block * 64 * WORDS + j]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([change] * len(a), pa.string())], ["a", "b", "change"])
            for bits in both:
                bits[rows] = 0

    blocks = -(-len(nodes) // (64 * WORDS))
    tasks = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, blocks, 1, tasks).mapInArrow(run, "a long, b long, change string")


# a commit takes small modules away and brings others
VIEWS["old_edges"] = View(("edges", "modules"), "SELECT e.src AS a, e.tgt AS b FROM {edges} e JOIN {modules} m ON m.id = e.tgt JOIN {modules} s ON s.id = e.src WHERE NOT (m.loc BETWEEN 400 AND 430) AND NOT (s.loc BETWEEN 400 AND 430)")
VIEWS["new_edges"] = View(("edges", "modules"), "SELECT e.src AS a, e.tgt AS b FROM {edges} e JOIN {modules} m ON m.id = e.tgt JOIN {modules} s ON s.id = e.src WHERE m.loc >= 50 AND s.loc >= 50")


@native(
    "i_03_incremental_closure",
    "old_edges",
    "new_edges",
    sql="WITH RECURSIVE o AS (SELECT a, b FROM {old_edges} UNION SELECT o.a, e.b FROM o JOIN {old_edges} e ON o.b = e.a), n AS (SELECT a, b FROM {new_edges} UNION SELECT n.a, e.b FROM n JOIN {new_edges} e ON n.b = e.a) SELECT a, b, 'LOST' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) x UNION ALL SELECT a, b, 'GAINED' FROM (SELECT * FROM n EXCEPT SELECT * FROM o) y",
)
def i_03_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commit changes in which module depends on which, directly or not."""
    scratch = Scratch(spark, "i03")
    old, new = (scratch.save(view(spark, sf_dir, f"{x}_edges").select(*PAIR).distinct(), x) for x in ("old", "new"))
    if old.count() + new.count() <= MOST_EDGES:
        return changed_blocks(old, new)
    lost, gained = changed_words(old, new, words(old, "i03-old"))
    return lost.withColumn("change", F.lit("LOST")).union(gained.withColumn("change", F.lit("GAINED")))
