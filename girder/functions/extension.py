"""What users add without touching the library: rules as table functions in SQL, and aggregates of their own whose states can be merged.

A rule is a class of a few lines: what it is called, and what it finds in the rows of one subject (a file, a document), which arrive
in order. ``register_rule`` makes a table function of it: ``SELECT * FROM <name>(TABLE(files) PARTITION BY path ORDER BY line)``. Its
schema comes from ``analyze``, which also refuses a table without the columns that the rule needs. One instance sees one partition
of the table, row by row, and holds what the rule holds.

An aggregate gives an empty state, what a batch of rows adds, how two states become one, and the result. Each task reduces its
own rows to a state a key before anything is shuffled, so a key with a third of all rows sends one state a task.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from girder.plans.operator import native, view


class Rule(ABC):
    """A rule of a user's own."""

    id: str
    severity: str = "MEDIUM"
    #: The column that names the subject, and those that the rule reads.
    subject: str
    needs: tuple[str, ...] = ()

    @abstractmethod
    def check(self, row: Row) -> Iterator[tuple[int, str]]:
        """(line, message) of what a row shows."""

    def end(self) -> Iterator[tuple[int, str]]:
        """(line, message) of what shows only once all rows of the subject were seen."""
        return iter(())


def register_rule(spark: SparkSession, name: str, rule: type[Rule]) -> None:
    """Makes ``rule`` the table function ``name`` of (subject, rule_id, severity, line, message)."""

    class Function:
        def __init__(self) -> None:
            self.rule, self.of = rule(), None

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(t) PARTITION BY {rule.subject})")
            have = {f.name: f.dataType for f in table.dataType.fields}
            lacking = [c for c in (rule.subject, *rule.needs) if c not in have]
            if lacking:
                raise ValueError(f"{name} needs the columns {', '.join(lacking)}")
            schema = StructType().add(rule.subject, have[rule.subject]).add("rule_id", StringType()).add("severity", StringType()).add("line", IntegerType()).add("message", StringType())
            return AnalyzeResult(schema)

        def _rows(self, found: Iterator[tuple[int, str]]) -> Iterator[tuple]:
            for line, message in found or ():
                yield self.of, rule.id, rule.severity, line, message

        def eval(self, row: Row) -> Iterator[tuple]:
            self.of = row[rule.subject]
            yield from self._rows(self.rule.check(row))

        def terminate(self) -> Iterator[tuple]:
            yield from self._rows(self.rule.end())

    spark.udtf.register(name, F.udtf(Function))


class Aggregate(ABC):
    """An aggregate of a user's own over ``columns``; states are any values that pickle can write."""

    columns: tuple[str, ...]
    returns: str

    @abstractmethod
    def empty(self):
        """The state of no rows."""

    @abstractmethod
    def add(self, state, rows: pa.RecordBatch):
        """The state after some rows."""

    @abstractmethod
    def merge(self, a, b):
        """One state of two; the order of states is not settled."""

    @abstractmethod
    def finish(self, state):
        """The result."""


def aggregated(df: DataFrame, by: str, aggregate: Aggregate, into: str) -> DataFrame:
    """(by, into): the aggregate of each key; null is a key of its own."""
    key_type = df.schema[by].dataType.simpleString()
    result = to_arrow_type(StructType.fromDDL(f"x {aggregate.returns}")["x"].dataType)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def out() -> pa.RecordBatch:
            keys = pa.array(list(states), kind)
            return pa.record_batch([keys, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [by, "state"])

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            keys = b.column(0)
            for k in keys.unique():
                rows = b.filter(pa.compute.equal(keys, k) if k.is_valid else pa.compute.is_null(keys))
                states[k.as_py()] = aggregate.add(states.get(k.as_py(), aggregate.empty()), rows.select(range(1, rows.num_columns)))
            if len(states) > 10_000:  # what is held stays bounded however many keys there are
                yield out()
                states = {}
        if states:
            yield out()

    def total(t: pa.Table) -> pa.Table:
        state = aggregate.empty()
        for s in t.column("state"):
            state = aggregate.merge(state, pickle.loads(s.as_py()))
        return pa.table({by: t.column(by).slice(0, 1), into: pa.array([aggregate.finish(state)], result)})

    states = df.select(by, *aggregate.columns).mapInArrow(partial, f"`{by}` {key_type}, state binary")
    return states.groupBy(by).applyInArrow(total, f"`{by}` {key_type}, `{into}` {aggregate.returns}")


class LongLines(Rule):
    """An example: lines of more than 300 characters, and texts with more than five of them."""

    id, severity, subject, needs = "USER-001", "LOW", "doc_id", ("text",)

    def __init__(self) -> None:
        self.found = 0

    def check(self, row: Row) -> Iterator[tuple[int, str]]:
        for k, line in enumerate((row["text"] or "").split("\n"), 1):
            if len(line) > 300:
                self.found += 1
                yield k, f"{len(line)} characters"

    def end(self) -> Iterator[tuple[int, str]]:
        if self.found > 5:
            yield 0, f"{self.found} long lines"


class Spread(Aggregate):
    """An example: the span between the shortest and the longest text."""

    columns, returns = ("n",), "long"

    def empty(self):
        return None

    def add(self, state, rows):
        lo_hi = pa.compute.min_max(rows.column(0))
        return self.merge(state, (lo_hi["min"].as_py(), lo_hi["max"].as_py()) if lo_hi["min"].is_valid else None)

    def merge(self, a, b):
        return a or b if a is None or b is None else (min(a[0], b[0]), max(a[1], b[1]))

    def finish(self, state):
        return None if state is None else state[1] - state[0]


@native(
    "x_01_rule_function",
    "texts",
    sql="""WITH l AS (SELECT doc_id, i AS line, length(p[i]) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM {texts}) t, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) u WHERE length(p[i]) > 300)
SELECT doc_id, 'USER-001' AS rule_id, 'LOW' AS severity, CAST(line AS INTEGER) AS line, concat(n, ' characters') AS message FROM l UNION ALL SELECT doc_id, 'USER-001', 'LOW', 0, concat(count(*), ' long lines') FROM l GROUP BY doc_id HAVING count(*) > 5""",
)
def x_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule over all texts, in SQL."""
    register_rule(spark, "long_lines", LongLines)
    return spark.sql("SELECT * FROM long_lines(TABLE({texts}) PARTITION BY doc_id)", texts=view(spark, sf_dir, "texts"))


@native("x_02_user_aggregate", "texts", sql="SELECT source, max(length(text)) - min(length(text)) AS spread FROM {texts} GROUP BY source")
def x_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate of the texts of each source."""
    return aggregated(view(spark, sf_dir, "texts").withColumn("n", F.length("text").cast("long")), "source", Spread(), "spread")
