"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Components become integers, floor(256 x) of the component as a double. Candidates are dealt into blocks of
bounded size; in a block, each dimension has a list of its rows sorted by value, read from the top where
the query's component is positive and from the bottom where it is negative. Sorted access goes down all
lists in step; every row it meets is scored in full; no unseen row can score above the threshold, the sum
of the query's components times the values at the present depth. A query stops in a block as soon as the
threshold cannot beat its kth score so far. Depth grows by a factor, so that scoring is one matrix product
a step.

Each query first searches one block; its kth score there is a floor under its final kth score, and goes
with the query into all other blocks, which stop as soon as their threshold falls below the floor.

Queries are a stated set of rows and are themselves dealt into blocks; each block of queries meets each
block of candidates once. Nothing is broadcast. Each pair of blocks gives k rows a query at most, and the
best k of those are the answer.

Nulls: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id. A shorter vector counts as padded with zeros, an empty one as zeros. Ties go to the smaller id; rows that
repeat are candidates each, dealt into blocks by their place, except those with the query's own id; of
queries with one id the smallest vector asks. A query with fewer than k candidates returns all. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import Scratch, table

K = 5
BLOCK = 4096
QUERY_BLOCK = 4096
FIRST_DEPTH, DEPTH_FACTOR = 4, 4


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of integers, padded to the width, as doubles: exact below 2**53."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def threshold_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list, int]:
    """The best k of each query over the rows of a block, but for some that score below the query's floor; also the rows scored."""
    n, width = rows.shape
    best = [(np.empty(0, np.int64), np.empty(0)) for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf) if floor is None else floor
    order = np.argsort(rows, axis=0, kind="stable")  # ascending; read backwards for positive components
    ordered = np.take_along_axis(rows, order, 0)
    positive, negative = queries > 0, queries < 0
    seen = np.zeros((len(query_ids), n), bool)
    scored, depth, alive = 0, min(FIRST_DEPTH, n), np.arange(len(query_ids))
    while len(alive):
        for q in alive:
            heads = np.concatenate([order[n - depth :, positive[q]].ravel(), order[:depth, negative[q]].ravel()])
            new = np.zeros(n, bool)
            new[heads] = True
            if depth >= n:
                new[:] = True  # also rows that a query of zeros never meets
            new &= ~seen[q]
            seen[q] |= new
            at = np.flatnonzero(new)
            scored += len(at)
            scores = rows[at] @ queries[q]
            other = row_ids[at] != query_ids[q]
            best[q] = _merge(np.concatenate([best[q][0], row_ids[at][other]]), np.concatenate([best[q][1], scores[other]]), k)
        if depth >= n:
            break
        bound = np.where(positive[alive], queries[alive] * ordered[n - depth], 0).sum(1) + np.where(negative[alive], queries[alive] * ordered[depth - 1], 0).sum(1)
        kth = np.array([max(best[q][1][-1], floor[q]) if len(best[q][1]) == k else floor[q] for q in alive])
        alive = alive[bound >= kth]  # an unseen row that ties may have a smaller id
        depth = min(n, depth * DEPTH_FACTOR)
    return best, scored


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the integer components of the rows that take part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def topk(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``is_query`` (a condition on ``id``) picks."""
    scratch = Scratch(vectors.sparkSession, "op1")
    rows = scratch.save(usable(vectors, id_col, vec_col).withColumn("r", F.monotonically_increasing_id()), "rows")
    n, q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-q // QUERY_BLOCK))
    h = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    candidates = rows.select("id", "v", h("r", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = scratch.save(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", h("id", query_blocks).alias("qb")), "queries")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            qv, cv = left.column("v").to_pylist(), right.column("v").to_pylist()
            width = max(max(map(len, qv)), max(map(len, cv)))
            ids, row_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            floor = left.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            best, _ = threshold_block(_matrix(qv, width), ids, _matrix(cv, width), row_ids, k, floor)
            for q, (found, scores) in zip(ids.tolist(), best, strict=True):
                out[0].extend([q] * len(found))
                out[1].extend(found.tolist())
                out[2].extend(scores.astype(np.int64).tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    def met(asked: DataFrame, held: DataFrame) -> DataFrame:
        return asked.groupBy("b", "qb").cogroup(held.groupBy("b", "qb")).applyInArrow(search, "query_id long, vec_id long, score long")

    none = F.lit(None).cast("long")
    found = met(queries.select("id", "v", none.alias("floor"), F.lit(0).alias("b"), "qb"), candidates.where("b = 0"))
    if blocks > 1:
        found = scratch.save(found, "first")
        floors = found.groupBy(F.col("query_id").alias("__q")).agg(F.count("*").alias("__n"), F.min("score").alias("__floor"))
        floors = floors.select("__q", F.when(F.col("__n") >= k, F.col("__floor")).alias("floor"))
        asked = queries.join(floors, F.col("id") == F.col("__q"), "left").select("id", "v", "floor", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1))).alias("b"), "qb")
        found = found.union(met(asked, candidates.where("b > 0")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v, true), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
