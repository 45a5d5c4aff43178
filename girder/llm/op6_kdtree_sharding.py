"""Shards by a k-d tree over metadata, split at distributed weighted medians.

Documents are points: language and source (each name's place in a hash order), length in characters and
size in bytes (log scale), all scaled to the unit interval. A node holding n shards is split along its
widest dimension into parts for n // 2 and n - n // 2 shards, at the point where the bytes below it are
in that proportion, until each leaf is one shard, that is until leaves reach the target bytes.

A split value is found by histograms, not by sorting or collecting rows: a coordinate is 20 bits, followed
by 40 bits of a hash of the row and of its number among equal rows, so that ties (one source with a third of
all rows, thousands of equal texts or of equal rows) can be cut anywhere. Each round sums bytes by node and by the next 10 bits within the bucket that
holds the cut: at most 16 x 1024 sums reach the driver, whatever the number of rows. The cut ends within
half of one row of the proportion. All nodes of a level share their rounds.

Slots count rows within a shard from 0 without gaps: rows are numbered within (shard, hash bucket) and
moved by the counts of the buckets before, so that no task holds a whole shard.

Nulls: a null text has size 1 and a null checksum; null metadata are a value of their own; a null doc_id
is hashed as such. Equal rows count each; fewer rows than shards leave some shards empty. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import Scratch, numbered, table

SHARDS = 16
DIMS = 4
COORD_BITS, TIE_BITS, ROUND_BITS = 20, 40, 10
BUCKETS = 4096


@dataclass
class Node:
    """``shards``: (first, number); ``leaf`` when one shard is left."""

    first: int
    n: int
    dim: int = -1
    cut: int = -1  # points at most cut go left


def _points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, c0..c3, row): a narrow row a document; ``row`` is a hash of all of it, equal for equal rows."""
    have = set(docs.columns)
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    chars = F.coalesce(F.col("n_chars").cast("double") if "n_chars" in have else F.length(text).cast("double"), F.lit(0.0))
    top = 2**COORD_BITS - 1

    def name(c: str) -> Column:
        return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) * top / 2**32 if c in have else F.lit(0.0)

    def log(x: Column) -> Column:
        return F.least(F.log2(F.greatest(x, F.lit(0.0)) + 1) / 40, F.lit(1.0)) * top

    coords = [name("lang"), name("source"), log(chars), log(size.cast("double"))]
    points = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.floor(F.coalesce(c, F.lit(0.0))).cast("long").alias(f"c{i}") for i, c in enumerate(coords)])
    return points.withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text_crc32", "size", *[f"c{i}" for i in range(DIMS)]))


def _told_apart(points: DataFrame, scratch: Scratch) -> DataFrame:
    """The points with ``h``, the hash that breaks ties, which differs between equal rows."""
    each = numbered(points, "row", scratch, "points", "copy")
    return each.withColumn("h", F.pmod(F.xxhash64("row", "copy"), F.lit(2**TIE_BITS))).drop("row", "copy")


def _key(dim: int) -> Column:
    """A dimension's coordinate and tie as one 60-bit number; each dimension breaks ties in its own order."""
    return F.shiftleft(F.col(f"c{dim}"), TIE_BITS) + F.col("h").bitwiseXOR(F.lit((0x9E3779B97F * (dim + 1)) % 2**TIE_BITS))


def _pick(values: list[int], index: Column) -> Column:
    """values[index] for a column of indices."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index.cast("int") + 1)


def kd_tree(points: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, list[list[Node]]]:
    """The points with the index of their leaf as ``node``, and the levels of the tree; the last holds one leaf a shard."""
    levels: list[list[Node]] = []
    level = [Node(0, shards)]
    points = points.withColumn("node", F.lit(0))
    while any(x.n > 1 for x in level):
        spread = {r["node"]: r for r in points.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"c{d}").alias(f"{f.__name__}{d}") for d in range(DIMS) for f in (F.min, F.max)]).collect()}
        for i, x in enumerate(level):
            if x.n > 1:
                x.dim, x.cut = 0, 2 ** (COORD_BITS + TIE_BITS)  # as for a node without rows
                if i in spread:
                    x.dim = int(np.argmax([spread[i][f"max{d}"] - spread[i][f"min{d}"] for d in range(DIMS)]))
        open_nodes = [i for i, x in enumerate(level) if x.n > 1 and i in spread]
        want = {i: spread[i]["bytes"] * (level[i].n // 2) / level[i].n for i in open_nodes}
        key = F.element_at(F.array(*map(_key, range(DIMS))), _pick([max(x.dim, 0) for x in level], F.col("node")).cast("int") + 1)
        keyed = points.select("node", "size", key.alias("key")).where(_pick([i in want for i in range(len(level))], F.col("node")) == 1)
        base, prefix = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        for shift in range(COORD_BITS + TIE_BITS - ROUND_BITS, -1, -ROUND_BITS) if open_nodes else ():
            inside = keyed.where(F.shiftright("key", shift + ROUND_BITS) == _pick([prefix.get(i, -1) for i in range(len(level))], F.col("node")))
            sums = inside.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("bytes")).collect()
            for i in open_nodes:
                mine = sorted((r["bucket"], r["bytes"]) for r in sums if r["node"] == i)
                run = base[i]
                for k, (bucket, size) in enumerate(mine):
                    if run + size > want[i] or k == len(mine) - 1:
                        base[i], prefix[i] = run, bucket
                        if shift == 0:
                            level[i].cut = bucket if 2 * run + size <= 2 * want[i] else bucket - 1
                        break
                    run += size
        levels.append(level)
        child, k = [], 0
        for x in level:
            child.append(k)
            k += 1 if x.n == 1 else 2
        right = (key > _pick([x.cut for x in level], F.col("node"))) & (_pick([x.n for x in level], F.col("node")) > 1)
        points = points.withColumn("node", (_pick(child, F.col("node")) + right.cast("int")).cast("int"))
        points = scratch.save(points, f"level-{len(levels)}")
        if len(levels) > 1:
            scratch.drop(f"level-{len(levels) - 1}")
        level = [y for x in level for y in ([Node(x.first, 1)] if x.n == 1 else [Node(x.first, x.n // 2), Node(x.first + x.n // 2, x.n - x.n // 2)])]
    return points, [*levels, level]


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; the number of shards, or the bytes that a shard aims at."""
    scratch = Scratch(docs.sparkSession, "op6")
    points = _told_apart(_points(docs, id_col, text_col), scratch)
    if shards is None:
        shards = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    points, levels = kd_tree(points, shards, scratch)
    leaf = _pick([x.first for x in levels[-1]], F.col("node"))
    placed = points.select("doc_id", "size", "text_crc32", leaf.cast("int").alias("shard"), (F.col("h") % BUCKETS).cast("int").alias("__bucket"))
    placed = scratch.save(placed, "placed")
    before = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    counts = counts.select(F.col("shard").alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = W.partitionBy("shard", "__bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = placed.withColumn("__k", F.row_number().over(within) - 1)
    joined = ranked.join(counts, (F.col("shard") == F.col("__shard")) & (F.col("__bucket") == F.col("__b")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("__base") + F.col("__k")).cast("long").alias("slot"))


def with_law(placed: DataFrame) -> DataFrame:
    """The law that the tree holds, sizes near equal, and no place in a grown layout."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_law(shard(table(spark, sf_dir, "documents"), SHARDS))
