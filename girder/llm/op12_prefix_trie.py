"""Prefix trie of conversations: which first turns conversations share, and what sharing saves.

A node is a distinct sequence of first turns. Each conversation has the prefixes of depth 0 to its length; the conversation
with the smallest id among those that share a prefix owns the node. What it owns goes from a first depth to its end, since
those that share a longer prefix share the shorter ones. So the tree is made of chains, one for each conversation that owns anything.

- Prefix digests: a turn at a place gives six numbers of 32 bits of a SHA-256; their sums over the turns, which blocks of
  ``BLOCK`` turns make independently of each other, name the prefix. No conversation needs to fit into a task.
- Prefix-digest minima: by digest the smallest id and the number of members, kept where there are two or more.
- The first owned depth of all conversations is found by binary search: each round meets one digest of each conversation
  that is still open with the minima, so the longest conversation's length gives ceil(log2) rounds. The last depth that is
  not owned names the parent.
- Bottom-up: each chain sums its own nodes; sums go from chain to chain by pointer doubling, which takes the logarithm of
  the chain tree's height in rounds, and within a chain by running sums over blocks.
- The hash over the ids that end at a node is fed in order by nature of SHA-256: ids are sorted over all tasks, each task joins
  its own to pieces of 64 KB, and the pieces of a node pass one task as a stream, whose memory is one piece.

Turns are ordered by their number, null first; turns of the same number by the SHA-256 of role and text. Null roles and texts
are empty ones. Rows without a conversation's id belong to none and are left out. Rows that repeat are turns of their own. An empty table
gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import Scratch, table

BLOCK = 1024
PIECE_BYTES = 64 << 10
LANES = 6
EMPTY = hashlib.sha256(b"").hexdigest()


def _sums(rows: DataFrame, key: list[str], place: str, values: list[str], scratch: Scratch, name: str, down: bool = False) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its running sum over the places (dense, from 0) of a key, from the last one if ``down``; blocks are summed on their own."""
    rows = rows.withColumn("__b", F.floor(F.col(place) / BLOCK))
    order = F.col(place).desc() if down else F.col(place)
    within = W.partitionBy(*key, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    block_order = F.col("__b").desc() if down else F.col("__b")
    before = W.partitionBy(*key).orderBy(block_order).rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy(*key, "__b").agg(*[F.sum(v).alias(f"__{v}") for v in values]).withColumns({f"__{v}": F.sum(f"__{v}").over(before) for v in values})
    bases = scratch.save(bases.where(F.col(f"__{values[0]}").isNotNull()), name)
    inside = rows.withColumns({v: F.sum(v).over(within) for v in values})
    met = inside.join(bases, [*key, "__b"], "left")
    return met.withColumns({v: F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0)) for v in values}).drop("__b", *[f"__{v}" for v in values])


def ranked(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, content, chars): each turn's place in its conversation, from 1, a digest of role and text, code points of the text.

    Turns are sorted over all tasks; places count within a task's share of a conversation and go on from the tasks before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.char_length(text).cast("long").alias("chars"), F.spark_partition_id().alias("__source"))
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "content", "__source")
    rows = scratch.save(rows.withColumn("__part", F.spark_partition_id()).drop("__source"), "sorted")
    counts = rows.groupBy("conv_id", "__part").agg(F.count("*").alias("__base"))
    counts = counts.withColumn("__base", F.sum("__base").over(W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    counts = scratch.save(counts.where("__base is not null"), "bases")
    place = F.row_number().over(W.partitionBy("conv_id", "__part").orderBy(F.col("turn").asc_nulls_first(), "content"))
    numbered = rows.withColumn("__k", place).join(counts, ["conv_id", "__part"], "left")
    return numbered.select("conv_id", (F.col("__k") + F.coalesce("__base", F.lit(0))).cast("long").alias("pos"), "content", "chars")


def rebuilt(turns: DataFrame, most: int = 5, every: int = 100) -> DataFrame:
    """The turns of each conversation c after the first h, preceded by the first h of conversation c - c % ``every``; h = crc32(c) % (most + 1)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = turns.select("conv_id").distinct().select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % every).alias("__base"), h.alias("h"))
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "__base")
    lengths = heads.groupBy("__base").agg(F.max("pos").alias("__n"))
    first = convs.join(heads, "__base").where("pos <= h").select(F.col("c").alias("conv_id"), "pos", "content", "chars")
    own = turns.withColumns({"__h": h, "__base": F.col("conv_id") - F.col("conv_id") % every}).where("pos > __h").join(lengths, "__base", "left")
    own = own.select("conv_id", (F.least("__h", F.coalesce("__n", F.lit(0))) + F.col("pos") - F.col("__h")).cast("long").alias("pos"), "content", "chars")
    return first.unionByName(own)


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, digest, chars) of each prefix that is not empty."""
    mixed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("content")), 256)
    lanes = {f"l{i}": F.conv(F.substring("mixed", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)}
    rows = turns.withColumn("mixed", mixed).withColumns(lanes).withColumn("__p", F.col("pos") - 1).drop("mixed", "content")
    rows = _sums(rows, ["conv_id"], "__p", list(lanes), scratch, "lane-bases")
    digest = F.unhex(F.md5(F.concat_ws(",", "pos", *lanes)))
    return rows.select("conv_id", F.col("pos").alias("depth"), digest.alias("digest"), "chars")


def first_owned(convs: DataFrame, paths: DataFrame, shared: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv_id, n, first, parent) for each conversation: its length, its first owned depth (n + 1 if it owns nothing) and the owner of the node above that.

    Between ``lo``, the deepest prefix known to be another's (whose owner is ``parent``), and ``first``, the shallowest known to be owned, half is left each round.
    """
    mine = F.col("conv_id") == root
    state = convs.withColumns({"lo": F.when(mine, -1).otherwise(0).cast("long"), "first": F.when(mine, 0).otherwise(F.col("n") + 1).cast("long"), "parent": F.when(~mine, F.lit(root)).cast("long")})
    state, rounds = scratch.save(state, "search-0"), 0
    found = []
    while True:
        open_now = state.where("first - lo > 1")
        found.append(state.where("first - lo <= 1"))
        rounds += 1
        if not open_now.take(1):
            break
        probes = open_now.withColumn("depth", F.floor((F.col("lo") + F.col("first")) / 2))
        met = probes.join(paths.select("conv_id", "depth", "digest"), ["conv_id", "depth"]).join(shared.select("digest", "owner"), "digest", "left")
        others = F.coalesce(F.col("owner") < F.col("conv_id"), F.lit(False))
        met = met.select("conv_id", "n", F.when(others, F.col("depth")).otherwise(F.col("lo")).alias("lo"), F.when(others, F.col("first")).otherwise(F.col("depth")).alias("first"), F.when(others, F.col("owner")).otherwise(F.col("parent")).alias("parent"))
        state = scratch.save(met, f"search-{rounds}")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.drop("lo")


def chain_totals(chains: DataFrame, root: int, values: list[str], scratch: Scratch) -> DataFrame:
    """(conv_id, ``values``) of each chain, summed with all chains below it; for the root's own chain no such sum is needed, and none is made.

    Pointer doubling: after k rounds a sum covers the chains less than 2**k below, and ``up`` is the chain 2**k above.
    """
    up = F.when(F.col("parent") != root, F.col("parent"))
    state, k = scratch.save(chains.select("conv_id", up.alias("up"), *values), "totals-0"), 0
    while state.where("up is not null").take(1):
        k += 1
        sums = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
        jump = state.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("__up"))
        met = state.join(sums, "conv_id", "left").join(jump, "up", "left")
        state = scratch.save(met.select("conv_id", F.col("__up").alias("up"), *[(F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values]), f"totals-{k}")
    return state.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of sorted nodes, joined by commas to pieces."""
    digest, first, parts, size, out = None, None, [], 0, []

    def close() -> None:
        nonlocal parts, size
        if parts:
            out.append((digest, first, ",".join(parts).encode()))
        parts, size = [], 0

    for batch in batches:
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d != digest or size >= PIECE_BYTES:
                close()
                digest, first = d, c
            parts.append(str(c))
            size += len(parts[-1]) + 1
        if len(out) >= 64:
            yield _piece_batch(out)
            out = []
    close()
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["digest", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order; what is held is the state of one hash."""
    digest, state = None, None
    for batch in batches:
        done = []
        for d, p in zip(batch.column(0), batch.column(2), strict=True):
            d = d.as_py()
            if d != digest:
                if state is not None:
                    done.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(p.as_py())
        yield _hash_batch(done)
    if state is not None:
        yield _hash_batch([(digest, state.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["digest", "ends_sha256"])


def ends(last: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, ends_sha256) of nodes at which conversations end. ``last``: (digest, conv_id)."""
    pieces = last.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest binary, first long, piece binary")
    pieces = scratch.save(pieces, "pieces")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of turns (conv_id, pos dense from 1, content, chars) of the conversations ``convs`` (conv_id), which may have none."""
    paths = scratch.save(prefixes(turns, scratch), "paths")
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("n"))
    convs = scratch.save(convs.select("conv_id").distinct().join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "convs")
    root, members = convs.agg(F.min("conv_id"), F.count("*")).first()
    if root is None:
        root = 0
    shared = paths.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1")
    shared = scratch.save(shared, "minima")
    chains = scratch.save(first_owned(convs, paths, shared, root, scratch), "chains")

    owners = chains.where("first <= n").withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("n") / BLOCK))))
    owned = paths.withColumn("__b", F.floor(F.col("depth") / BLOCK)).join(owners, ["conv_id", "__b"]).where("depth >= first")
    owned = owned.join(shared.select("digest", "n_convs"), "digest", "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    nodes = owned.select("conv_id", "depth", parent.alias("parent_conv_id"), F.coalesce("n_convs", F.lit(1)).cast("long").alias("n_convs"), "chars", "digest", "first", "n")
    top = convs.where(F.col("conv_id") == root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("first"), "n")
    nodes = scratch.save(nodes.unionByName(top), "nodes")

    tied = nodes.where("depth = first and depth > 0").select("conv_id", F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"))
    tied = scratch.save(tied, "tied")
    forks = tied.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("forks"))
    own = nodes.join(forks, ["conv_id", "depth"], "left").withColumn("forks", F.coalesce("forks", F.lit(0)))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    own = own.withColumns({"saved": weight, "leaves": ((F.col("depth") == F.col("n")) & (F.col("forks") == 0)).cast("long")})
    own = scratch.save(own, "own")
    totals = own.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = chain_totals(totals.join(tied, "conv_id", "left"), root, ["leaves", "saved"], scratch)
    below = tied.join(totals, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
    full = own.join(below, ["conv_id", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0)) for v in ("leaves", "saved")}).drop("__leaves", "__saved")
    full = _sums(full, ["conv_id"], "depth", ["leaves", "saved"], scratch, "total-bases", down=True)

    last = convs.where("n > 0").join(paths.select("conv_id", F.col("depth").alias("n"), "digest"), ["conv_id", "n"]).select("digest", "conv_id")
    last = last.unionByName(convs.where("n = 0").select(F.lit(b"").alias("digest"), "conv_id"))
    full = full.join(ends(last, scratch), "digest", "left")
    children = F.col("forks") + (F.col("depth") < F.col("n")).cast("long")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turn, role, text)."""
    scratch = Scratch(conversations.sparkSession, "op12")
    turns = scratch.save(ranked(conversations, scratch), "turns")
    return trie(turns, turns.select("conv_id"), scratch)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    turns = scratch.save(ranked(table(spark, sf_dir, "conversations"), scratch), "turns")
    return trie(rebuilt(turns), turns.select("conv_id"), scratch)


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT n, n AS r, 0 AS k FROM range(256) x(n) UNION ALL SELECT n, CASE WHEN r % 2 = 1 THEN xor(3988292384, r // 2) ELSE r // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(r ORDER BY n) AS f FROM bits WHERE k = 8
), convs AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a // 256, f[(xor(a, x) & 255) + 1]::BIGINT))) % 6 AS h
  FROM (SELECT DISTINCT c FROM t), crc
), nb AS (SELECT c AS base, least(max(pos), 5) AS nb FROM t GROUP BY 1
), r AS (
  SELECT convs.c, t.pos, t.role, t.text FROM convs JOIN t ON t.c = convs.base AND t.pos <= convs.h
  UNION ALL
  SELECT convs.c, least(convs.h, coalesce(nb, 0)) + t.pos - convs.h, t.role, t.text FROM convs JOIN t ON t.c = convs.c AND t.pos > convs.h LEFT JOIN nb ON nb.base = convs.base
), p AS (
  SELECT c, pos AS d, md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY pos)) AS k, length(text) AS chars FROM r
  UNION ALL SELECT c, 0, '', 0 FROM convs
), n AS (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(chars) AS w FROM p GROUP BY k
), up AS (
  SELECT n.k, n.d, n.c, q.k AS above FROM n LEFT JOIN p q ON q.c = n.c AND q.d = n.d - 1
), kids AS (SELECT above AS k, count(*) AS kids FROM up WHERE above IS NOT NULL GROUP BY 1
), sub AS (
  SELECT q.k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum(w) AS saved FROM n JOIN p q ON q.c = n.c AND q.d <= n.d LEFT JOIN kids ON kids.k = n.k GROUP BY 1
), e AS (
  SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) USING (c, d) GROUP BY 1
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, a.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN up USING (k) LEFT JOIN n a ON a.k = up.above JOIN sub ON sub.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN e ON e.k = n.k
"""
