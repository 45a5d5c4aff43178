"""Properties of expressions, and states where branches meet, against folds of two states at a time."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from girder.operators import evidence

CASES = {
    "int(a)": {"VALIDATED_TYPE", "TYPE_COERCED", "SQL_SAFE"},
    "  parseInt(a, 10)": {"VALIDATED_TYPE", "TYPE_COERCED", "SQL_SAFE"},
    "f(int(a))": set(),
    "print(a)": set(),
    "a > 1 and a < 5": {"VALIDATED_RANGE"},
    "rand(a) >= 0": {"VALIDATED_RANGE"},
    "a && b": set(),
    "a\n> b &&\nc": {"VALIDATED_RANGE"},
    "a in ALLOWED": {"VALIDATED_ENUM"},
    "set.has(a)": {"VALIDATED_ENUM"},
    "shlex.quote(a)": {"COMMAND_SAFE", "SHELL_QUOTED"},
    "urllib.parse.quote(a)": {"COMMAND_SAFE", "SHELL_QUOTED", "URL_SAFE"},
    "encodeURIComponent(a)": {"URL_SAFE"},
    "DOMPurify.sanitize(a)": {"HTML_SAFE", "HTML_ESCAPED"},
    "psycopg2.sql.Literal(a)": {"SQL_SAFE"},
    "os.path.abspath(html.escape(a))": {"PATH_SAFE", "PATH_NORMALIZED", "HTML_SAFE", "HTML_ESCAPED"},
    "": set(),
    "x" * 200_000 + " in A": {"VALIDATED_ENUM"},
}


def test_properties_and_sinks(spark):
    df = spark.createDataFrame([(i, e) for i, e in enumerate([*CASES, None])], "i int, expr string").withColumn("p", evidence.properties())
    got = {r["i"]: r for r in df.withColumn("s", evidence.safe_for(F.col("p"))).collect()}
    for i, want in enumerate([*CASES.values(), set()]):
        assert got[i]["p"] == sorted(want | {"UNTRUSTED"}), i
        typed = bool(want & {"VALIDATED_TYPE", "TYPE_COERCED"})
        safe = {"SQL_EXECUTE": "SQL_SAFE" in want, "COMMAND_EXECUTE": "COMMAND_SAFE" in want, "DOM_INJECTION": "HTML_SAFE" in want, "CODE_EVAL": "VALIDATED_ENUM" in want, "FILE_PATH": bool(want & {"PATH_SAFE", "VALIDATED_ENUM"})}
        assert {s["sink"]: s["safe"] for s in got[i]["s"]} == {k: v or typed for k, v in safe.items()}
    kept = df.limit(1).select(evidence.properties("expr", F.array(F.lit("URL_SAFE"))).alias("q")).first()["q"]
    assert kept == ["SQL_SAFE", "TYPE_COERCED", "URL_SAFE", "VALIDATED_TYPE"]


def meet(a, b):
    """Two states at a time."""
    unsafe = {"UNTRUSTED", "UNKNOWN"}
    objects = {}
    for v in {*a["objects"], *b["objects"]}:
        x, y = (s["objects"].get(v, ((), False, False, False)) for s in (a, b))
        all_ = sorted({*x[0], *y[0]})
        objects[v] = (tuple(all_[:4]), x[1] or y[1], x[2] or y[2] or len(all_[:4]) > 1, x[3] or y[3] or len(all_) > 4)
    facts = {f for f in a["facts"] for g in b["facts"] if f[0] == g[0] and (f[1] == g[1] or (f[2] and g[2]))}
    return {"properties": {p for p in a["properties"] | b["properties"] if p in unsafe or p in a["properties"] & b["properties"]}, "objects": objects, "facts": facts}


def states(r, n):
    out = []
    for _ in range(n):
        objects = {}
        for v in r.sample("xyz", r.randint(0, 3)):
            own = tuple(sorted(r.sample("abcdefgh", r.randint(0, 2))))
            objects[v] = (own, r.random() < 0.1, len(own) > 1 or r.random() < 0.1, r.random() < 0.05)
        facts = {(v, r.choice(["int", "str"]), r.random() < 0.7) for v in "xy" for _ in range(r.randint(0, 2))}
        out.append({"properties": set(r.sample(["UNTRUSTED", "UNKNOWN", "SQL_SAFE", "URL_SAFE"], r.randint(0, 4))), "objects": objects, "facts": facts})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_a_fold(spark, seed):
    r = random.Random(seed)
    points = {p: states(r, r.choice([1, 1, 2, 2, 3, 6])) for p in range(60)}
    points[99] = states(r, 1) * 400  # one place where many branches meet
    rows = [(p, i, sorted(s["properties"])) for p, ss in points.items() for i, s in enumerate(ss)]
    objects = [(p, v, o, *x[1:]) for p, ss in points.items() for s in ss for v, x in s["objects"].items() for o in (x[0] or (None,))]
    facts = [(p, i, *f) for p, ss in points.items() for i, s in enumerate(ss) for f in s["facts"]]
    df = spark.createDataFrame(rows, "point int, branch int, properties array<string>")
    want = {p: reduce(meet, ss) for p, ss in points.items()}
    got = evidence.met_properties(df)
    assert sorted(map(tuple, got.collect())) == sorted((p, x) for p, s in want.items() for x in s["properties"])
    got = evidence.met_objects(spark.createDataFrame(objects, "point int, name string, object string, unknown boolean, ambiguous boolean, truncated boolean"))
    assert sorted((x["point"], x["name"], tuple(x["objects"]), x["unknown"], x["ambiguous"], x["truncated"]) for x in got.collect()) == sorted((p, v, *x) for p, s in want.items() for v, x in s["objects"].items())
    got = evidence.met_facts(df, spark.createDataFrame(facts, "point int, branch int, name string, refined_type string, is_numeric boolean"))
    assert sorted(map(tuple, got.collect())) == sorted((p, *f) for p, s in want.items() for f in s["facts"])


def test_joins_of_nothing(spark):
    df = spark.createDataFrame([], "point int, branch int, properties array<string>")
    assert evidence.met_properties(df).count() == 0
    assert evidence.met_objects(spark.createDataFrame([], "point int, name string, object string, unknown boolean, ambiguous boolean, truncated boolean")).count() == 0
    assert evidence.met_facts(df, spark.createDataFrame([], "point int, branch int, name string, refined_type string, is_numeric boolean")).count() == 0
