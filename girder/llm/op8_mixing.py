"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words. A target beyond the source's own size is met by whole
repeats of the source plus a share of one more; a target below it by a share. A share is a hash
threshold: the documents whose hash lies under it. Thresholds nest, so a larger budget takes a superset,
and a rerun takes the same rows.

The threshold comes without sorting: words are summed by source and by the hash's leading digit (4096
buckets); only the bucket that holds the budget is refined by the next digit, and so on, until its
documents are told apart. The taken words end within half of one document of the target. Sums are
grouped by (source, bucket), so a source with a third of all rows is spread over 4096 groups.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null doc_id is
hashed as such with its text. Rows equal in source, doc_id and text are numbered, and the number is hashed
with them, so that a threshold may lie between them; which of such rows is which does not matter. A source
without words has target 0. An empty table gives no rows. Other columns are ignored by ``mix_plan`` and kept by
``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import WORD, Scratch, fresh, is_empty, numbered, table

#: Weights that the sources take in turn, in order of their names.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
DIGITS, LEVELS = 12, 5  # 60 bits of hash


def row_key(source: Column, doc_id: Column, text: Column) -> Column:
    """MD5 over source, id and the text's own MD5: equal for equal rows."""
    named = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))
    return F.md5(F.concat(named, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def row_hash(key: Column, number: Column) -> Column:
    """60 bits of MD5 over a row's key and its number among equal rows, as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), number.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(__source, source_size, target) from one row (__source, source_size) a source.

    Targets share all words by weight, stop at ``most`` times the source's size, and the excess goes to
    the others by weight until none is above. In order of ``most * size / weight`` the stopped sources
    are a prefix, so one running sum finds the level. One row a source meets in one task here; the
    number of rows in the sources does not matter.
    """
    k = len(weights)
    ranked = sizes.withColumn("__n", F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("__n") - 1) % k + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight.cast("long")).withColumn("__cap", F.col("source_size") * most)
    order = W.orderBy(F.col("__cap") / F.col("__w"), "__n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        ranked.withColumn("__left", F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__weight", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__open", F.col("__cap") * F.col("__weight") > F.col("__w") * F.col("__left"))
        .withColumn("__first", F.min(F.when(F.col("__open"), F.struct(F.col("__cap") / F.col("__w"), "__n", "__left", "__weight"))).over(everything))
    )
    stopped = F.col("__first").isNull() | (F.struct(F.col("__cap") / F.col("__w"), "__n") < F.struct(F.col("__first.col1"), F.col("__first.__n")))
    target = F.when(stopped, F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__first.__left") / F.col("__first.__weight"))
    return level.select("__source", "source_size", target.alias("target"))


def mix_thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, __source, size, __key, __hash), and a row (__s, source_size, target, __whole, __cut) for each source.

    The mix takes a document ``__whole`` times, and once more if its hash is ``__cut`` at most.
    """
    scratch = Scratch(docs.sparkSession, "op8")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("__source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key(F.col(source_col), F.col(id_col), text).alias("__key"),
    )
    rows = numbered(rows, "__key", scratch, "rows", "__n").withColumn("__hash", row_hash(F.col("__key"), F.col("__n")))
    digit = lambda level: F.shiftright("__hash", DIGITS * (LEVELS - 1 - level)) if level < LEVELS - 1 else F.col("__hash")

    first = rows.groupBy("__source", digit(0).alias("__bucket")).agg(F.sum("size").alias("__words"))
    first = scratch.save(first, "histogram")
    targets = source_targets(first.groupBy("__source").agg(F.sum("__words").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    targets = targets.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    targets = scratch.save(targets, "targets")

    def around(histogram: DataFrame) -> DataFrame:
        """The one bucket of each source that holds its budget, with the words before it."""
        run = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
        seen = histogram.withColumn("__after", F.col("__base") + F.sum("__words").over(run)).withColumn("__before", F.col("__after") - F.col("__words"))
        return seen.where("__before <= __rest and __after > __rest")

    rest = targets.select(F.col("__source").alias("__s"), "__rest")
    sums = first.join(rest, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__base", F.lit(0).cast("long"))
    near = scratch.save(around(sums).select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.col("__before").alias("__base"), "__rest"), "near-0")
    inside = rows
    for level in range(1, LEVELS):
        held = inside.select("__source", "size", "__hash").join(near, F.col("__source").eqNullSafe(F.col("__s")) & (digit(level - 1) == F.col("__b")))
        inside = scratch.save(held.select("__source", "size", "__hash", "__base", "__rest"), f"inside-{level}")
        finer = inside.groupBy("__source", digit(level).alias("__bucket"), "__base", "__rest").agg(F.sum("size").alias("__words"))
        near = scratch.save(around(finer).select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.col("__before").alias("__base"), "__after", "__rest"), f"near-{level}")
    # the last bucket is one hash: its documents come along if that ends nearer to the budget
    cut = near.select(F.col("__s").alias("__t"), F.when(F.col("__base") + F.col("__after") <= 2 * F.col("__rest"), F.col("__b")).otherwise(F.col("__b") - 1).alias("__cut"))
    cuts = targets.join(cut, F.col("__source").eqNullSafe(F.col("__t")), "left")
    return rows, scratch.save(cuts.select(F.col("__source").alias("__s"), "source_size", "target", "__whole", F.coalesce("__cut", F.lit(-1)).alias("__cut")), "thresholds")


def _copies() -> Column:
    return F.col("__whole") + F.when(F.col("__hash") <= F.col("__cut"), 1).otherwise(0)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """For each row (doc_id, size, source_size, target, taken, copies): how often the mix takes it.

    Rows meet the thresholds (a row a source) by a join that Spark broadcasts where its size allows and
    splits by skew where it doesn't.
    """
    rows, cuts = mix_thresholds(docs, id_col, text_col, source_col, weights, most)
    joined = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), _copies().alias("copies"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they were.

    Only rows that have equals are written, to be numbered; all others meet the thresholds as they are read.
    """
    rows, cuts = mix_thresholds(docs, weights=weights, most=most)
    key, number, source, whole, cut, copies, copy, k = fresh(docs, "__key", "__n", "__s", "__whole", "__cut", "__copies", "__copy", "__k")
    cuts = cuts.select(F.col("__s").alias(source), F.col("__whole").alias(whole), F.col("__cut").alias(cut))
    keyed = docs.withColumn(key, row_key(F.col("source"), F.col("doc_id"), F.col("text")))
    repeated = rows.where("__n > 0").select(F.col("__key").alias(k)).distinct()
    if is_empty(repeated):
        each = keyed.withColumn(number, F.lit(0).cast("long"))
    else:
        same = F.col(key) == F.col(k)
        alone = keyed.join(repeated, same, "left_anti").withColumn(number, F.lit(0).cast("long"))
        many = numbered(keyed.join(repeated, same, "left_semi"), key, Scratch(docs.sparkSession, "op8"), "repeated", number)
        each = alone.unionByName(many)
    times = F.col(whole) + F.when(row_hash(F.col(key), F.col(number)) <= F.col(cut), 1).otherwise(0)
    joined = each.join(cuts, F.col("source").eqNullSafe(F.col(source))).withColumn(copies, times).where(F.col(copies) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(key || '|' || (row_number() OVER (PARTITION BY key) - 1)), 1, 15))::BIGINT AS h
  FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce('s' || source, '-') || '|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS key
    FROM documents
  ) k
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM r
), run AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
  FROM w
), first_open AS (
  SELECT cap / w AS ratio, n, rest, weight FROM run WHERE cap * weight > w * rest ORDER BY cap / w, n LIMIT 1
), t AS (
  SELECT run.source, run.source_size,
         CASE WHEN f.n IS NULL OR (run.cap / run.w, run.n) < (f.ratio, f.n) THEN run.cap::DOUBLE
              ELSE (run.w * f.rest)::DOUBLE / f.weight::DOUBLE END AS target
  FROM run LEFT JOIN first_open f ON true
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t
), g AS (
  SELECT source, h, sum(size) AS words FROM d GROUP BY source, h
), c AS (
  SELECT source, h, sum(words) OVER (PARTITION BY source ORDER BY h) AS after, words FROM g
)
SELECT d.doc_id, d.size, k.source_size, k.target,
       (d.size * (k.whole + CASE WHEN c.after + c.after - c.words <= 2 * (k.target - k.whole * k.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
