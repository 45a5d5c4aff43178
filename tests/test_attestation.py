"""Merkle roots against a plain tree, and signatures."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from girder.operators import attestation as at


def plain(contents, sort=True):
    level = [hashlib.sha256(b"\x00" + c.encode()).digest() for c in contents]
    level = sorted(level) if sort else level
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + (level[i + 1] if i + 1 < len(level) else level[i])).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_roots_of_groups_of_all_sizes(spark, levels):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33] if levels < 10 else [1, 2, 3, 1023, 1024, 1025, 2047, 2049]
    rows = [(f"g{n}", f"leaf {i % max(1, n - 2)}") for n in sizes for i in range(n)]  # the last two repeat the first
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x string").repartition(6)
    subjects = spark.createDataFrame([(f"g{n}",) for n in sizes] + [("none",)], "g string")
    got = {r["g"]: (r["leaves"], r["merkle_root"]) for r in at.merkle_roots(df, "g", F.col("x"), subjects=subjects, levels=levels).collect()}
    assert got == {f"g{n}": (n, plain([x for g, x in rows if g == f"g{n}"])) for n in sizes} | {"none": (0, hashlib.sha256(b"EMPTY_FINDINGS").hexdigest())}


def test_a_large_group(spark):
    df = spark.range(100_000).select(F.lit("all").alias("g"), F.col("id").cast("string").alias("x"))
    assert at.merkle_roots(df, "g", F.col("x")).first()["merkle_root"] == plain([str(i) for i in range(100_000)])


def test_no_leaves_and_null_contents(spark):
    df = spark.createDataFrame([("a", None), (None, "x"), (None, "y")], "g string, x string")
    assert at.merkle_roots(df.where("false"), "g", F.col("x")).count() == 0
    assert {r["g"]: r["merkle_root"] for r in at.merkle_roots(df, "g", F.col("x")).collect()} == {"a": plain([""]), None: plain(["x", "y"])}


def test_a_workspace_goes_by_repository(spark):
    roots = spark.createDataFrame([("w", f"r{i}", f"{i}" * 64) for i in (3, 1, 2)], "workspace string, repo_id string, merkle_root string")
    got = at.workspace_roots(roots, "workspace", spark.createDataFrame([("w",), ("v",)], "workspace string")).collect()
    assert {r["workspace"]: r["merkle_root"] for r in got} == {"w": plain([f"r{i}:{str(i) * 64}" for i in (1, 2, 3)], sort=False), "v": at.EMPTY_WORKSPACE}


def test_signatures(spark):
    e = at.sign({"a": 1.0, "b": "é"}, b"k")
    assert at.verify(e, b"k") and not at.verify(e, b"other")
    for none in (b"", None):
        with pytest.raises(ValueError):
            at.sign({}, none)
        with pytest.raises(ValueError):
            at.attested(spark.createDataFrame([], "repo_id string, merkle_root string"), none)
    rows = at.attested(spark.createDataFrame([("r", "00")], "repo_id string, merkle_root string"), b"k")
    assert rows.select(at.verified(F.col("envelope"), b"k")).first()[0] and not rows.select(at.verified(F.col("envelope"), b"l")).first()[0]


def test_the_session_names_the_key(spark):
    spark.conf.set(at.KEY_SETTING, b"named".hex())
    assert at.session_key(spark) == b"named"
    spark.conf.unset(at.KEY_SETTING)
    assert len(at.session_key(spark)) == 32 and at.session_key(spark) != at.session_key(spark)
