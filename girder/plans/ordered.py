"""Places and running sums in a total order, without a task that holds a whole group or the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.plans.scratch import Scratch


def placed(df: DataFrame, scratch: Scratch, name: str, order: Sequence[Column | str], by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``place``, the place of each row of its group in the order, from 0, and each of ``sums`` summed up to and with it as ``<sum>_to``.

    Rows are sorted over all tasks by ranges of (group, order) and written with the number of their range. Counts and sums
    within a range are moved by those of the ranges before, of which there is a row for each group and range. Rows
    that the order doesn't tell apart are dealt out by the task that they come from, so not even those meet in one range.
    """
    by, sums = list(by), list(sums)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumn("__source", F.spark_partition_id()).repartitionByRange(*by, *order, "__source").withColumn("__range", F.spark_partition_id())
    rows = scratch.save(rows.drop("__source"), f"{name}-sorted")
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = {"place": F.count("*"), **{f"{v}_to": F.sum(v) for v in sums}}
    bases = rows.groupBy(*by, "__range").agg(*[x.alias(f"__{k}") for k, x in carried.items()])
    bases = bases.select(*by, "__range", *[F.sum(f"__{k}").over(before).alias(f"__{k}") for k in carried]).where("__place is not null")
    bases = scratch.save(bases, f"{name}-bases")
    within = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = {"place": F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order)) - 1, **{f"{v}_to": F.sum(v).over(within) for v in sums}}
    rows, keys = rows.withColumns(own), [*by, "__range"]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = rows.alias("l").join(bases.alias("r"), same, "left")
    moved = [(F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"__{k}"), F.lit(0))).alias(k) if k != "place" else (F.col("place") + F.coalesce(F.col("__place"), F.lit(0))).cast("long").alias("place") for k in own]
    return both.select(*[F.col(f"l.{c}") for c in df.columns], *moved)
