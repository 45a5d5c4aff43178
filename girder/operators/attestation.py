"""Merkle roots of findings and workspaces, and signed statements about them."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from base64 import b64decode, b64encode
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from girder.operators.code import canonical_json
from girder.plans.operator import native, view
from girder.plans.ordered import placed
from girder.plans.scratch import Scratch

#: What leaves and inner nodes are hashed under, and the roots of what is empty.
LEAF, INNER = b"\x00", b"\x01"
EMPTY_FINDINGS, EMPTY_WORKSPACE = hashlib.sha256(b"EMPTY_FINDINGS").hexdigest(), hashlib.sha256(b"EMPTY_WORKSPACE").hexdigest()
#: A task reduces subtrees of 2**LEVELS leaves.
LEVELS = 10


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def merkle_roots(leaves: DataFrame, by: str, content: Column, order: Sequence[Column] | None = None, subjects: DataFrame | None = None, empty: str = EMPTY_FINDINGS, levels: int = LEVELS) -> DataFrame:
    """(``by``, leaves, merkle_root): binary trees over the leaves of each group, in order of their hash or of ``order``; an odd node pairs with itself.

    Leaves get their place by a sort over all tasks. Each round cuts the nodes into aligned subtrees of 2**levels, which are
    reduced on their own: all of them to exactly that height, so that the last, shorter one pairs its odd nodes as the whole
    tree would, but for a group that has one subtree only, whose height ends it. The roots of subtrees are the next round's
    nodes, so rounds go with the logarithm of the largest group, and what meets in a row are 2**levels hashes at most.
    ``subjects`` (``by``): groups of which some may have no leaves, whose root is ``empty``. A null content is an empty one.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    hashed = leaves.select(by, _sha(F.concat(F.lit(LEAF), F.coalesce(content.cast("string"), F.lit("")).cast("binary"))).alias("node"), *([F.struct(*order).alias("__key")] if order else []))
    nodes = placed(hashed, scratch, "leaves", ["__key"] if order else ["node"], [by]).select(by, "place", "node")
    nodes = scratch.save(nodes, "nodes-0")
    counts = scratch.save(nodes.groupBy(by).agg(F.count("*").alias("leaves")), "counts")
    size, k = F.col("size"), 0
    state = counts.select(F.col(by).alias("__by"), F.col("leaves").alias("size"))
    while state.where("size > 1").take(1):
        k += 1
        height = F.least(F.ceil(F.log2(size)), F.lit(levels)).cast("int")
        met = nodes.join(state.where("size > 1"), F.col(by).eqNullSafe(F.col("__by"))).withColumn("height", height)
        trees = met.groupBy(by, "height", F.floor(F.col("place") / 2**levels).alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("tree"))
        for level in range(levels):
            pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("tree") / 2).cast("int") - 1), lambda i: _sha(F.concat(F.lit(INNER), F.get(F.col("tree"), 2 * i), F.coalesce(F.get(F.col("tree"), 2 * i + 1), F.get(F.col("tree"), 2 * i)))))
            trees = trees.withColumn("tree", F.when(F.col("height") > level, pairs).otherwise(F.col("tree")))
        done = nodes.join(state.where("size <= 1"), F.col(by).eqNullSafe(F.col("__by"))).select(by, "place", "node")
        nodes = scratch.save(trees.select(by, "place", F.get(F.col("tree"), F.lit(0)).alias("node")).unionByName(done), f"nodes-{k}")
        state = state.select("__by", F.ceil(size / 2**levels).alias("size"))
    roots = nodes.select(F.col(by).alias("__by"), F.lower(F.hex("node")).alias("merkle_root"))
    roots = counts.join(roots, F.col(by).eqNullSafe(F.col("__by"))).select(by, "leaves", "merkle_root")
    if subjects is None:
        return roots
    every = subjects.select(F.col(by).alias("__s")).distinct().join(roots, F.col("__s").eqNullSafe(F.col(by)), "left")
    return every.select(F.col("__s").alias(by), F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"), F.coalesce("merkle_root", F.lit(empty)).alias("merkle_root"))


def findings_roots(findings: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """(repo_id, leaves, merkle_root) over rule, path, line and stripped snippet of each finding."""
    content = F.concat_ws(":", "rule_id", "file_path", F.col("line").cast("string"), F.trim(F.coalesce("snippet", F.lit(""))))
    return merkle_roots(findings, "repo_id", content, subjects=repositories)


def workspace_roots(roots: DataFrame, workspace: str, workspaces: DataFrame | None = None) -> DataFrame:
    """(workspace, leaves, merkle_root) over the roots of its repositories, in order of the repository's id. roots: (workspace, repo_id, merkle_root)."""
    return merkle_roots(roots, workspace, F.concat_ws(":", "repo_id", "merkle_root"), [F.col("repo_id")], workspaces, EMPTY_WORKSPACE)


def _oracle(leaves: str, by: str, order: str) -> str:
    """Level after level of the whole tree. leaves: (by, content, and what order needs)."""
    return f"""WITH RECURSIVE leaves AS ({leaves}), hashed AS (SELECT *, sha256('\\x00'::BLOB || encode(content)) AS h FROM leaves),
t AS (
  SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS pos, h, count(*) OVER (PARTITION BY {by}) AS n, count(*) OVER (PARTITION BY {by}) AS leaves FROM hashed
  UNION ALL
  SELECT {by}, pos // 2, sha256('\\x01'::BLOB || unhex(min_by(h, pos)) || unhex(max_by(h, pos))), (n + 1) // 2, leaves FROM t WHERE n > 1 GROUP BY {by}, pos // 2, n, leaves
) SELECT {by}, leaves, h AS merkle_root FROM t WHERE n = 1"""


_FINDINGS = _oracle("SELECT repo_id, concat(rule_id, ':', file_path, ':', line, ':', trim(snippet)) AS content FROM {findings}", "repo_id", "h")


@native("a_23_merkle_root", "findings", sql=_FINDINGS)
def a_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_roots(view(spark, sf_dir, "findings"))


_WORKSPACE = _oracle(f"SELECT 'all' AS workspace, repo_id, concat(repo_id, ':', merkle_root) AS content FROM ({_FINDINGS}) f", "workspace", "repo_id")


@native("a_24_workspace_merkle_root", "findings", sql=_WORKSPACE)
def a_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace_roots(a_23(spark, sf_dir).withColumn("workspace", F.lit("all")), "workspace")


def pae(kind: str, body: bytes) -> bytes:
    """What a DSSE signature is made over."""
    return b"DSSEv1 %d %s %d %s" % (len(kind), kind.encode(), len(body), body)


def sign(statement: dict, key: bytes, kind: str = "application/vnd.in-toto+json") -> dict:
    """A DSSE envelope; the key must be given."""
    if not key:
        raise ValueError("a signing key is required")
    body = canonical_json(statement).encode()
    return {"payloadType": kind, "payload": b64encode(body).decode(), "signatures": [{"sig": hmac.new(key, pae(kind, body), hashlib.sha256).hexdigest()}]}


def verify(envelope: dict, key: bytes) -> bool:
    expected = hmac.new(key, pae(envelope["payloadType"], b64decode(envelope["payload"])), hashlib.sha256).hexdigest()
    return any(hmac.compare_digest(s["sig"], expected) for s in envelope["signatures"])


def attested(roots: DataFrame, key: bytes, subject: str = "repo_id") -> DataFrame:
    """``roots`` with ``envelope``, the signed statement of each subject's root as JSON."""
    if not key:
        raise ValueError("a signing key is required")

    @F.pandas_udf(StringType())
    def envelope(names: pd.Series, merkle: pd.Series) -> pd.Series:
        return pd.Series([canonical_json(sign({"subject": a, "merkle_root": b}, key)) for a, b in zip(names, merkle, strict=True)])

    return roots.withColumn("envelope", envelope(subject, "merkle_root"))


def verified(envelope: Column, key: bytes) -> Column:
    """Whether an envelope's signature is of that key."""
    import json

    @F.pandas_udf(BooleanType())
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: verify(json.loads(t), key))

    return check(envelope)


#: The session's setting that names the signing key, in hex.
KEY_SETTING = "spark.girder.attestation.key"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names; one of its own, made now and kept nowhere else, if it names none."""
    return bytes.fromhex(spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))


@native("m_03_attestation", "findings", sql=f"""SELECT repo_id, merkle_root, concat('{{"merkle_root":"', merkle_root, '","subject":"', repo_id, '"}}') AS statement, true AS valid, false AS valid_under_other_key, false AS valid_if_changed FROM ({_FINDINGS}) f""")
def m_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed statement a repository; it verifies, and neither under another key nor with another root."""
    key = session_key(spark)
    rows = attested(a_23(spark, sf_dir), key)
    statement = F.unbase64(F.get_json_object("envelope", "$.payload")).cast("string")
    other = F.base64(F.encode(F.replace(statement, F.col("merkle_root"), F.lit(EMPTY_FINDINGS)), "UTF-8"))
    changed = F.replace("envelope", F.get_json_object("envelope", "$.payload"), F.regexp_replace(other, r"\s", ""))
    return rows.select("repo_id", "merkle_root", statement.alias("statement"), verified(F.col("envelope"), key).alias("valid"), verified(F.col("envelope"), key[::-1] + b"x").alias("valid_under_other_key"), verified(changed, key).alias("valid_if_changed"))
