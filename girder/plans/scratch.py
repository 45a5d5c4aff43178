"""Tables written once under the shared checkpoint folder, to end lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="girder-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has begun.
BEGUN: list[str] = []


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/girder-{name}-{uuid.uuid4().hex}"
        BEGUN.append(self.folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def clear(spark: SparkSession) -> int:
    """Deletes the scratch tables of this process once no result that rests on them is needed; how many folders that were."""
    n = len(BEGUN)
    while BEGUN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(BEGUN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
