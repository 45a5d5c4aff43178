"""Names by hash and chains of events against plain Python."""

import hashlib
import uuid

from girder.operators import code

NAMES = ["", "a", "ARC-001:src/ä.py:1:2", "x" * 100_000, "日本語", "\n", "😀", "null", *map(str, range(200))]


def test_uuid5(spark):
    df = spark.createDataFrame([*enumerate(NAMES), (-1, None)], "i int, name string")
    got = {r["i"]: r["u"] for r in df.select("i", code.uuid5(df["name"]).alias("u")).collect()}
    assert got == {-1: None} | {i: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for i, n in enumerate(NAMES)}
    other = df.where("i = 1").select(code.uuid5(df["name"], uuid.NAMESPACE_DNS).alias("u")).first()["u"]
    assert other == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a"))


def test_chains_longer_than_a_batch(spark):
    rows = [(c, t, "user" if t % 2 else None, f"text {t}" if t % 3 else None) for c, n in ((1, 50), (2, 1), (None, 7)) for t in range(n)] + [(3, None, "a", "b"), (3, 0, "z", ""), (3, 0, "a", "x"), (3, 0, "a", "x")]
    order = lambda r: tuple((x is not None, x or (0 if isinstance(x, int) else "")) for x in (r[1] if r[1] is not None else None, r[2], r[3]))
    want = []
    for chain in (1, 2, 3, None):
        prev = "0" * 64
        for _, turn, role, text in sorted((r for r in rows if r[0] == chain), key=order):
            h = hashlib.sha256(f"{turn}|{role}|{text}|{prev}".encode()).hexdigest()
            want.append((chain, turn, prev, h))
            prev = h
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [tuple(r) for r in code.chain_append(df).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert code.chain_append(df.limit(0)).count() == 0
