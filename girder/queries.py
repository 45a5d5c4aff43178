"""All queries of the engine and their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import girder.functions.extension
import girder.functions.scalars
import girder.operators.attestation
import girder.operators.code
import girder.operators.compliance
import girder.operators.evidence
import girder.operators.findings
import girder.operators.governance
import girder.operators.graph
import girder.operators.incremental
import girder.operators.matching
import girder.operators.progress
import girder.operators.project
import girder.operators.simulation
import girder.operators.source_code
import girder.operators.summaries
import girder.operators.triage
import girder.sources.cache
import girder.sources.extract
import girder.sources.sinks
from girder.plans.operator import NATIVE, REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: op.query for k, op in [*REGISTRY.items(), *NATIVE.items()]}


def oracle_sql() -> dict[str, str]:
    every = {k: op.sql() for k, op in REGISTRY.items() if op.oracle} | {k: op.sql() for k, op in NATIVE.items()}
    return {k: v for k, v in every.items() if v}
