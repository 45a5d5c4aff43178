"""Operators as declarative plans: SQL over named relations, one text for the Spark and the DuckDB dialect.

An operator is a relation-to-relation function: called with DataFrames for its inputs it returns a lazy
DataFrame that Catalyst plans as a whole. ``queries()`` feeds it the logical views of ``views``; a user feeds
it own tables with the same columns. ``Dialect`` spells the few functions whose names differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from girder.plans.views import VIEWS, tables_of, view


class Dialect:
    """Spark's spelling."""

    name = "spark"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def re(self, pattern: str) -> str:
        """A regular expression as a literal without escapes."""
        return "r'" + pattern.replace("'", "\\x27").replace("{", "{{").replace("}", "}}") + "'"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, '{to}')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.re(pattern)})"

    def get(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, '{by}')"

    def joined(self, x: str, by: str = ",", distinct: bool = False) -> str:
        """The sorted values of a group as one string."""
        return f"array_join(array_sort(collect_{'set' if distinct else 'list'}({x})), '{by}')"

    def each(self, array: str, alias: str) -> str:
        """A lateral relation of an array's elements: alias(pos, x), from 0."""
        return f"LATERAL VIEW posexplode({array}) {alias} AS pos, x"

    def at(self, array: str, i: str) -> str:
        """Element i of an array, from 1; null beyond its ends."""
        return f"try_element_at({array}, {i})"

    def days(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"


class Duck(Dialect):
    name = "duckdb"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def re(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, '{to.replace('$', chr(92))}', 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.re(pattern)})"

    def split(self, x: str, by: str) -> str:
        plain = by.replace("[", "").replace("]", "")
        return f"string_split({x}, '{plain}')" if plain != r"\n" else f"string_split({x}, chr(10))"

    def joined(self, x: str, by: str = ",", distinct: bool = False) -> str:
        return f"coalesce(string_agg({'DISTINCT ' if distinct else ''}{x}, '{by}' ORDER BY {x}), '')"

    def each(self, array: str, alias: str) -> str:
        return f", LATERAL (SELECT i - 1 AS pos, l[i] AS x FROM (SELECT {array} AS l), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)) {alias}"

    def at(self, array: str, i: str) -> str:
        return f"({array})[{i}]"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {b}, {a})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"


SPARK, DUCK = Dialect(), Duck()


@dataclass(frozen=True)
class Operator:
    """``inputs``: names of the relations that ``text`` reads; ``text``: the plan in a dialect."""

    id: str
    inputs: tuple[str, ...]
    text: Callable[[Dialect], str]
    oracle: bool = True

    def __call__(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        return spark.sql(self.text(SPARK), **{k: frames[k] for k in self.inputs})

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self(spark, **{k: view(spark, sf_dir, k) for k in self.inputs})

    def sql(self) -> str:
        """The same plan for DuckDB, over the same views of the base tables."""
        needed: list[str] = []

        def add(name: str) -> None:
            if name in VIEWS and name not in needed:
                for x in VIEWS[name].inputs:
                    add(x)
                needed.append(name)

        for name in self.inputs:
            add(name)
        body = self.text(DUCK)
        for name in self.inputs:
            body = body.replace("{" + name + "}", name)
        ctes = []
        for name in needed:
            text = VIEWS[name].sql
            for x in VIEWS[name].inputs:
                text = text.replace("{" + x + "}", x)
            ctes.append(f"{name} AS (\n{text}\n)")
        return f"WITH RECURSIVE {', '.join(ctes)}\nSELECT * FROM (\n{body}\n) AS result" if ctes else body


REGISTRY: dict[str, Operator] = {}


def operator(id: str, *inputs: str, oracle: bool = True) -> Callable[[Callable[[Dialect], str]], Operator]:
    """Registers a function from dialect to SQL as the operator of that id."""

    def add(text: Callable[[Dialect], str]) -> Operator:
        op = Operator(id, inputs, text, oracle)
        REGISTRY[id] = op
        return op

    return add


@dataclass(frozen=True)
class Native:
    """An operator in the DataFrame API, with its SQL for the oracle if SQL can express it."""

    id: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle_inputs: tuple[str, ...] = ()
    oracle_text: str | None = None

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(spark, sf_dir)

    def sql(self) -> str | None:
        return Operator(self.id, self.oracle_inputs, lambda d: self.oracle_text).sql() if self.oracle_text else None


NATIVE: dict[str, Native] = {}


def native(id: str, *inputs: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        NATIVE[id] = Native(id, fn, inputs, sql)
        return fn

    return add


__all__ = ["DUCK", "NATIVE", "REGISTRY", "SPARK", "Dialect", "Native", "Operator", "native", "operator", "tables_of", "view"]
