"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from girder.llm import op1_exact_topk as op1
from girder.llm import op2_quality_cnn as op2
from girder.llm import op3_toxicity as op3
from girder.llm import op4_license as op4
from girder.llm import op5_url_filter as op5
from girder.llm import op6_kdtree_sharding as op6
from girder.llm import op7_secrets as op7
from girder.llm import op8_mixing as op8
from girder.llm import op9_decontamination as op9
from girder.llm import op10_ngram_jaccard as op10
from girder.llm import op11_warc as op11
from girder.llm import op12_prefix_trie as op12
from girder.llm import op13_fim as op13


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, whose module stands at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1.op1_exact_topk,
    "op2_quality_cnn": op2.op2_quality_cnn,
    "op3_toxicity": op3.op3_toxicity,
    "op4_license": op4.op4_license,
    "op5_url_filter": op5.op5_url_filter,
    "op6_kdtree_sharding": op6.op6_kdtree_sharding,
    "op7_secrets": op7.op7_secrets,
    "op8_mixing": op8.op8_mixing,
    "op9_decontamination": op9.op9_decontamination,
    "op10_ngram_jaccard": op10.op10_ngram_jaccard,
    "op11_warc": op11.op11_warc,
    "op12_prefix_trie": op12.op12_prefix_trie,
    "op13_fim": op13.op13_fim,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": op1.SQL,
    "op4_license": op4.SQL,
    "op5_url_filter": op5.SQL,
    "op7_secrets": op7.SQL,
    "op8_mixing": op8.SQL,
    "op11_warc": op11.SQL,
    "op12_prefix_trie": op12.SQL,
    "op13_fim": op13.SQL,
}
