"""An append-only audit trail as a table: hash chains that go on from batch to batch, each batch exactly once.

``foreachBatch`` may be called again with a batch that was partly or wholly written. So each batch writes below its own number,
over what an attempt before has left, and its number in the ledger is its commit, written last: a batch in the ledger is not written again, and
readers take batches in the ledger only. Chain heads are written by batch as well, for the chains that it touches; the head of a chain is
that of its latest batch before.

Within a batch events go to the task of their chain, in order, and the hash is carried along: memory is one batch of Arrow rows however long a chain is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "conv_id long, turn long, role string, text string"
CHAINED = "conv_id long, turn long, prev_hash string, event_hash string"
START = "0" * 64


def event_hash(turn, role, text, prev: str) -> str:
    return hashlib.sha256(f"{turn}|{role}|{text}|{prev}".encode()).hexdigest()


def chained(events: DataFrame, heads: DataFrame) -> DataFrame:
    """``CHAINED``: events hashed in order of their turn, each chain from its head (conv_id, head) on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev = None, START
        for b in batches:
            rows = []
            for c, turn, role, text, head in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != chain:
                    chain, prev = c, head or START
                h = event_hash(turn, role, text, prev)
                rows.append((c, turn, prev, h))
                prev = h
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "prev_hash", "event_hash"])

    joined = events.join(heads, "conv_id", "left").select("conv_id", "turn", "role", "text", "head")
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, CHAINED)


class Trail:
    """The table below ``folder``: events, heads and the ledger."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> DataFrame:
        """(batch)"""
        at = f"{self.folder}/ledger"
        return self.spark.read.schema("batch long").parquet(at) if self._exists(at) else self.spark.createDataFrame([], "batch long")

    def _parts(self, name: str, schema: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        if not self._exists(at):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(at)
        return rows.join(F.broadcast(self.committed()), "batch", "left_semi")  # a number a batch

    def events(self) -> DataFrame:
        return self._parts("events", CHAINED).drop("batch")

    def heads(self) -> DataFrame:
        """(conv_id, head, events) of each chain."""
        rows = self._parts("heads", "conv_id long, head string, events long")
        return rows.groupBy("conv_id").agg(F.max_by("head", "batch").alias("head"), F.sum("events").alias("events"))

    def append(self, events: DataFrame, batch: int, between: Callable[[str], None] = lambda step: None) -> None:
        """Chains a batch on. ``between`` is called after each step, for tests that fail there."""
        if self.committed().where(F.col("batch") == batch).take(1):
            return
        at = f"{self.folder}/events/batch={batch}"
        chained(events, self.heads().select("conv_id", "head")).write.mode("overwrite").parquet(at)
        between("events")
        rows = self.spark.read.schema(CHAINED).parquet(at)
        rows.groupBy("conv_id").agg(F.max_by("event_hash", "turn").alias("head"), F.count("*").alias("events")).write.mode("overwrite").parquet(f"{self.folder}/heads/batch={batch}")
        between("heads")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
        between("ledger")

    def follow(self, source: str, state: str, files_a_batch: int = 1, between: Callable[[str], None] = lambda step: None) -> None:
        """Chains on the files that lie in ``source`` and that no run before has committed."""
        read = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        read.writeStream.foreachBatch(lambda df, n: self.append(df, n, between)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def broken(events: DataFrame) -> DataFrame:
    """Events that do not point to the one before them in their chain. events: ``CHAINED``, all of them."""
    before = events.select(F.col("conv_id").alias("c"), F.col("event_hash").alias("known")).distinct()
    first = events.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    linked = events.join(before, (F.col("conv_id") == F.col("c")) & (F.col("prev_hash") == F.col("known")), "left_anti")
    return linked.join(first.withColumn("first", F.lit(True)), ["conv_id", "turn"], "left").where(~(F.coalesce("first", F.lit(False)) & (F.col("prev_hash") == START))).select(events.columns)
