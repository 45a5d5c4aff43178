"""Helpers that every operator of this subpackage shares: reading tables, scratch tables, ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``, by Spark's reader only (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    It is set here only where it is unset on a local master (tests); elsewhere an unset folder is an
    error, since executors of a cluster share no temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="girder-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written once under the shared folder, so that lineage ends there and a lost executor costs no rework."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/girder-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3: remainder 1 is held out from all learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 3


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def numbered(df: DataFrame, key: str, scratch: Scratch, name: str, number: str) -> DataFrame:
    """``df``, written once, with the place of each row among the rows of its key as ``number``, from 0.

    Rows of one key must be interchangeable. The write fixes the partition that a row belongs to; places are
    counted within (key, partition) and follow those of the partitions before, so no task holds a whole key.
    """
    part, base, k, p = fresh(df, "__part", "__base", "__k", "__p")
    rows = scratch.save(df.withColumn(part, F.spark_partition_id()), name)
    counts = rows.groupBy(key, part).agg(F.count("*").alias(base))
    repeated = counts.groupBy(F.col(key).alias(k)).agg(F.sum(base).alias(base)).where(F.col(base) > 1).select(k)
    if is_empty(repeated):
        return rows.drop(part).withColumn(number, F.lit(0).cast("long"))
    before = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.join(repeated, F.col(key) == F.col(k), "left_semi")
    bases = bases.select(F.col(key).alias(k), F.col(part).alias(p), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    many = rows.join(repeated, F.col(key) == F.col(k), "left_semi")
    many = many.withColumn(number, F.row_number().over(W.partitionBy(key, part).orderBy(F.lit(1))) - 1)
    many = many.join(bases, (F.col(key) == F.col(k)) & (F.col(part) == F.col(p))).withColumn(number, (F.col(number) + F.col(base)).cast("long"))
    alone = rows.join(repeated, F.col(key) == F.col(k), "left_anti").withColumn(number, F.lit(0).cast("long"))
    cols = [c for c in rows.columns if c != part] + [number]
    return scratch.save(many.select(*cols).union(alone.select(*cols)), f"{name}-numbered")
