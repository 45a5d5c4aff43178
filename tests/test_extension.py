"""A user's rule and aggregate, from outside of the library."""

import pyarrow as pa
import pytest

from girder.functions.extension import Aggregate, Rule, Spread, aggregated, register_rule


class Todo(Rule):
    id, subject, needs = "MINE-7", "path", ("line", "code")

    def __init__(self):
        self.seen = []

    def check(self, row):
        if "TODO" in (row["code"] or ""):
            self.seen.append(row["line"])
            yield row["line"], "to do"

    def end(self):
        if len(self.seen) > 1:
            yield self.seen[-1], f"{len(self.seen)} left"


def test_a_rule_joins_in_sql(spark):
    register_rule(spark, "todo_rule", Todo)
    rows = [("a", 2, "# TODO"), ("a", 1, "TODO x"), ("b", 1, None), ("b", 2, "TODO"), (None, 1, "TODO")]
    spark.createDataFrame(rows, "path string, line int, code string").createOrReplaceTempView("code_lines")
    spark.createDataFrame([("a", "ann"), ("b", "bob")], "path string, owner string").createOrReplaceTempView("owners")
    got = spark.sql("SELECT o.owner, f.rule_id, f.line, f.message FROM todo_rule(TABLE(code_lines) PARTITION BY path ORDER BY line) f JOIN owners o ON o.path = f.path").collect()
    assert sorted(map(tuple, got)) == [("ann", "MINE-7", 1, "to do"), ("ann", "MINE-7", 2, "2 left"), ("ann", "MINE-7", 2, "to do"), ("bob", "MINE-7", 2, "to do")]
    assert spark.sql("SELECT * FROM todo_rule(TABLE(code_lines) PARTITION BY path)").where("path is null").count() == 1
    assert spark.sql("SELECT * FROM todo_rule(TABLE(SELECT * FROM code_lines WHERE false) PARTITION BY path)").count() == 0
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM todo_rule(TABLE(owners) PARTITION BY path)").collect()


class Mean(Aggregate):
    columns, returns = ("x", "w"), "double"

    def empty(self):
        return (0.0, 0.0)

    def add(self, state, rows):
        return self.merge(state, (sum(a * b for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), float(pa.compute.sum(rows.column(1)).as_py())))

    def merge(self, a, b):
        return (a[0] + b[0], a[1] + b[1])

    def finish(self, state):
        return state[0] / state[1] if state[1] else None


def test_an_aggregate_merges(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3}", float(i), i % 4 + 1) for i in range(1000)]
    got = {r["k"]: r["mean"] for r in aggregated(spark.createDataFrame(rows, "k string, x double, w int").repartition(7), "k", Mean(), "mean").collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert got[k] == pytest.approx(sum(r[1] * r[2] for r in mine) / sum(r[2] for r in mine))
    assert aggregated(spark.createDataFrame([], "k string, x double, w int"), "k", Mean(), "mean").count() == 0
    assert [r["s"] for r in aggregated(spark.createDataFrame([("a", None)], "k string, n long"), "k", Spread(), "s").collect()] == [None]
