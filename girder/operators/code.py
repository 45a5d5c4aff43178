"""Operators over source text, and those that need Python by their nature: uuid5, canonical JSON, chains."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from girder.plans.operator import native, view
from girder.plans.views import VIEWS, View

#: Small Python files for tests of the readers.
TEMPLATES = (
    "import os\nimport subprocess\n\ndef run(request):\n    cmd = request.args.get('c')\n    safe = int(cmd)\n    os.system(cmd)\n    subprocess.run(cmd, shell=True)\n    return safe\n",
    "from flask import request\nfrom . import db\n\ndef find(cursor):\n    name = request.form['n']\n    if name:\n        q = f\"SELECT * FROM t WHERE n = '{name}'\"\n    else:\n        q = 'SELECT 1'\n    cursor.execute(q)\n    cursor.execute('SELECT %s', name)\n",
    "import hashlib\nDEBUG = True\n\nclass Store:\n    def key(self, x):\n        return hashlib.md5(x).hexdigest()\n\n    def ok(self, x):\n        return hashlib.md5(x, usedforsecurity=False)\n",
    "import shlex\nfrom django.views.decorators.csrf import csrf_exempt\n\n@csrf_exempt\ndef view(request):\n    a = request.GET['a']\n    b = shlex.quote(a)\n    os.system(b)\n    eval(a)\n\ndef _hidden():\n    return 1\n",
    "def broken(:\n",
    "CORS_ALLOW_ALL_ORIGINS = True\n\ndef loop(cursor, request):\n    total = ''\n    for i in range(3):\n        total = total + request.args['x']\n    cursor.executemany(total)\n\ndef clean(cursor, request):\n    n = int(request.args['n'])\n    cursor.execute('SELECT %d' % n)\n",
)


# ids and canonical forms


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version 5 of a name in a namespace; null for a null name: SHA-1 of both, 16 bytes of it, with the version and the variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(name.isNotNull(), parts)


_NAME = "concat_ws(':', rule_id, file_path, CAST(line AS VARCHAR), CAST(col AS VARCHAR))"


_HASHED = f"SELECT input_pos, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode({_NAME})) AS h FROM {{findings}}"


@native("p_07_uuid5", "findings", sql=f"SELECT input_pos, concat_ws('-', h[1:8], h[9:12], concat('5', h[14:16]), concat(substr('89ab', CAST(concat('0x', h[17]) AS INTEGER) % 4 + 1, 1), h[18:20]), h[21:32]) AS uuid FROM ({_HASHED}) f")
def p_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "findings")
    return f.select("input_pos", uuid5(F.concat_ws(":", "rule_id", "file_path", F.col("line").cast("string"), F.col("col").cast("string"))).alias("uuid"))


def canonical_json(x) -> str:
    """Sorted keys, NFC strings, integral floats as integers, no NaN."""

    def norm(v):
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError("not a JSON number")
            return int(v) if v == int(v) else v
        if isinstance(v, dict):
            return {norm(k): norm(y) for k, y in sorted(v.items(), key=lambda p: p[0].encode())}
        return [norm(y) for y in v] if isinstance(v, list | tuple) else v

    return json.dumps(norm(x), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical(rows: pd.Series) -> pd.Series:
    return rows.map(lambda t: None if t is None else canonical_json(json.loads(t)))


_CANONICAL = """concat('{"file_path":"', file_path, '","line":', CAST(line AS VARCHAR), ',"rule_id":"', rule_id, '","value":', CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END, '}')"""


@native("p_26_canonical_json", "findings", sql=f"SELECT input_pos, sha256({_CANONICAL}) AS digest FROM {{findings}}")
def p_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "findings")
    return f.select("input_pos", F.sha2(canonical(F.to_json(F.struct("rule_id", "file_path", "line", "value"))), 256).alias("digest"))


def normalise_path(path: Column) -> Column:
    """Relative path without empty, . and .. segments; null if it would leave its root."""
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        out = F.when((x == "") | (x == ".") | F.array_contains(acc, ".."), acc).when((x == "..") & (F.size(acc) == 0), F.array(F.lit("..")))  # once out of the root, out for good
        return out.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), start, step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


#: Paths as configurations and imports spell them: with dots, doubled and backward slashes, up and down again, some out of their root.
VIEWS["spelled_paths"] = View(
    ("files",),
    r"""
SELECT pos, CASE language WHEN 'python' THEN concat('./', replace(path, '/', '/./')) WHEN 'typescript' THEN concat(replace(path, '/', '/x/../'), '//') WHEN 'javascript' THEN concat('a/b/../../', replace(path, '/', chr(92)))
       ELSE concat(CASE WHEN size_bytes > 1000 THEN '../../' ELSE 'lib/../../lib/' END, path, '/..') END AS path
FROM {files}""".strip(),
)


@native(
    "p_03_normalise_relative_path",
    "spelled_paths",
    sql="SELECT pos, CASE WHEN n <> '!' THEN substr(n, 2) END AS norm FROM (SELECT pos, list_reduce(list_prepend('', string_split(replace(path, chr(92), '/'), '/')), lambda acc, x: CASE WHEN acc = '!' THEN acc WHEN x IN ('', '.') THEN acc WHEN x = '..' AND acc = '' THEN '!' WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE concat(acc, '/', x) END) AS n FROM {spelled_paths}) r",
)
def p_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "spelled_paths").select("pos", normalise_path(F.col("path")).alias("norm"))


# chains


def chain_append(events: DataFrame) -> DataFrame:
    """(conv_id, turn, prev_hash, event_hash): each chain folded in order of turn, role and text; chains are independent.

    A hash needs the one before, so a chain passes one task, but as a sorted stream: what a task holds of it is a batch and the last hash.
    Nulls count as the word None; chains without an id are one chain.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev = object(), ""
        for b in batches:
            before, after = [], []
            for conv, turn, role, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if conv != chain:
                    chain, prev = conv, "0" * 64
                before.append(prev)
                prev = hashlib.sha256(f"{turn}|{role}|{text}|{prev}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], ["conv_id", "turn", "prev_hash", "event_hash"])

    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(fold, "conv_id long, turn long, prev_hash string, event_hash string")


@native(
    "w_09_chain_append",
    "turns",
    sql="WITH RECURSIVE o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {turns}), c AS (SELECT conv_id, turn, k, repeat('0', 64) AS prev_hash, sha256(turn || '|' || role || '|' || text || '|' || repeat('0', 64)) AS event_hash FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.turn, o.k, c.event_hash, sha256(o.turn || '|' || o.role || '|' || o.text || '|' || c.event_hash) FROM c JOIN o ON o.conv_id = c.conv_id AND o.k = c.k + 1) SELECT conv_id, turn, prev_hash, event_hash FROM c",
)
def w_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_append(view(spark, sf_dir, "turns"))


@native("l_06_bounded_context", "texts", sql="SELECT doc_id, array_to_string(CASE WHEN len(l) > 40 THEN list_concat(l[1:25], l[len(l)-14:len(l)]) ELSE l END, chr(10)) AS context FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {texts})")
def l_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail lines of long texts."""
    lines = F.split("text", "\n")
    cut = F.when(F.size(lines) > 40, F.concat(F.slice(lines, 1, 25), F.slice(lines, -15, 15))).otherwise(lines)
    return view(spark, sf_dir, "texts").select("doc_id", F.array_join(cut, "\n").alias("context"))
