"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir) that gives the next stage its documents.

Each stage takes documents with any further columns and gives them on as they were; the last gives each document's place.
Nulls: a null text is scored as an empty one, has no near copies, holds no benchmark item, and weighs nothing in the mix, so a
source that is cut takes it by its hash like any other; a null doc_id or source is a value of its own. Rows that repeat are
near copies of each other, of which one stays; those without words all stay. An empty table gives an empty one. Without
labels the classifier rejects nothing; without a benchmark nothing is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.llm import op2_quality_cnn, op6_kdtree_sharding, op8_mixing, op9_decontamination, op10_ngram_jaccard
from girder.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return op2_quality_cnn.keep_good(docs, op2_quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return op10_ngram_jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op9_decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return op8_mixing.apply_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in 16 shards of near equal size."""
    return op6_kdtree_sharding.with_law(op6_kdtree_sharding.shard(docs, op6_kdtree_sharding.SHARDS))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL cannot express the classifier, and the stages after it work on what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
