"""A code base over the base tables: a file a part, written from its row and from the parts ordered with it.

``units`` says by rule what each file does; ``unit_calls`` which other file's function it calls. ``source_files`` turns both
into text, which the extraction operators read. Oracles never see the text: they follow from units and unit_calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.plans.views import VIEWS, View, view

VIEWS["units"] = View(
    ("part",),
    """
SELECT p_partkey AS fn, CASE WHEN p_partkey % 8 = 3 THEN 'javascript' WHEN p_partkey % 8 = 7 THEN 'go' ELSE 'python' END AS language, CAST(p_partkey % 5 AS INT) AS pkg,
       concat('src/pkg', CAST(p_partkey % 5 AS STRING), '/m', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 8 = 3 THEN '.js' WHEN p_partkey % 8 = 7 THEN '.go' ELSE '.py' END) AS path,
       p_size % 5 = 0 AS is_source, p_size % 3 = 0 AS sanitised, p_size % 7 = 0 AS guarded, CAST(p_size % 4 AS INT) AS sink,
       p_partkey % 8 NOT IN (3, 7) AND p_partkey % 13 = 0 AS dead, p_partkey % 8 NOT IN (3, 7) AND p_partkey % 13 <> 0 AND p_partkey % 17 = 0 AS validated,
       p_partkey % 8 NOT IN (3, 7) AND p_partkey % 6 = 0 AS stores, p_partkey % 8 NOT IN (3, 7) AND p_partkey % 2 = 0 AS helps, p_partkey % 8 NOT IN (3, 7) AND p_partkey % 11 = 0 AS shares,
       p_partkey % 8 NOT IN (3, 7) AND p_partkey % 9 = 0 AND p_partkey % 11 <> 0 AS asks, md5(concat(p_name, CAST(p_partkey AS STRING))) AS secret
FROM {part}""".strip(),
)
VIEWS["unit_calls"] = View(
    ("calls", "units"),
    """
SELECT DISTINCT c.caller, c.callee FROM {calls} c JOIN {units} a ON a.fn = c.caller JOIN {units} b ON b.fn = c.callee AND b.language = a.language WHERE a.language <> 'go'""".strip(),
)
#: What a unit's own value is safe for, as bits: SQL 1, COMMAND 2, DOM 4, EVAL 8.
CLEAN = "CASE WHEN {u}.guarded OR ({u}.sanitised AND {u}.language = 'python') THEN 15 WHEN {u}.sanitised THEN 4 ELSE 0 END"
#: The sink of a unit as a bit; 0: none.
SINK = "CASE WHEN {u}.language = 'python' AND {u}.sink = 0 THEN 1 WHEN {u}.language = 'python' AND {u}.sink = 1 THEN 2 WHEN {u}.language = 'javascript' AND {u}.sink = 0 THEN 4 WHEN {u}.language = 'javascript' AND {u}.sink = 1 THEN 8 ELSE 0 END"
VIEWS["unit_taint"] = View(
    ("units",),
    f"SELECT u.fn, u.language, u.path, u.is_source, {CLEAN.format(u='u')} AS clean, {SINK.format(u='u')} AS sink_bit FROM {{units}} u WHERE u.language <> 'go'",
)
CATEGORY = "CASE {bit} WHEN 1 THEN 'SQL' WHEN 2 THEN 'COMMAND' WHEN 4 THEN 'DOM' WHEN 8 THEN 'EVAL' END"

_PYTHON = """
concat(
 'import os\\nfrom flask import request\\n', CASE WHEN fn % 21 = 0 OR fn % 22 = 0 THEN 'import hashlib\\n' ELSE '' END, CASE WHEN fn % 6 = 0 THEN concat('from pkg', pkg, '.gone import lost\\n') ELSE '' END,
 array_join(transform(callees, c -> concat('from ', CASE WHEN c % 5 = pkg THEN '' ELSE concat('pkg', c % 5) END, '.m', c, ' import f', c, '\\n')), ''),
 CASE WHEN fn % 10 = 0 THEN concat('API_KEY = "', secret, '"\\n') ELSE '' END, CASE WHEN fn % 25 = 0 THEN 'DEBUG = True\\n' ELSE '' END,
 CASE WHEN fn % 23 = 0 THEN 'CORS_ALLOW_ALL_ORIGINS = True\\n' ELSE '' END, CASE WHEN fn % 21 = 0 THEN 'hashlib.md5(b"")\\n' ELSE '' END, CASE WHEN fn % 22 = 0 THEN 'hashlib.md5(b"", usedforsecurity=False)\\n' ELSE '' END,
 CASE WHEN stores THEN 'class Store:\\n    def save(self, v):\\n        return v\\n' ELSE '' END,
 CASE WHEN helps THEN concat('def _h', fn, '(v, flag):\\n    if flag:\\n        return v\\n    return None\\n') ELSE '' END,
 CASE WHEN shares THEN 'def shared(v):\\n    return v\\n' ELSE '' END, CASE WHEN fn = 1 THEN 'def only_here(v):\\n    return v\\n' ELSE '' END,
 CASE WHEN fn % 26 = 0 THEN '@csrf_exempt\\n' ELSE '' END, 'def f', fn, '(a, cursor):\\n', CASE WHEN fn % 19 = 0 THEN '    eval("1")\\n' ELSE '' END,
 CASE WHEN validated THEN '    if a is None:\\n        raise ValueError("a")\\n' ELSE '' END,
 CASE WHEN dead THEN '    if a is None:\\n        return None\\n    if a is None:\\n        os.system("never")\\n' ELSE '' END,
 CASE WHEN is_source THEN '    x = request.args["q"]\\n' ELSE '    x = a\\n' END,
 CASE WHEN sanitised THEN '    x = int(x)\\n' ELSE '' END,
 CASE WHEN guarded THEN '    if not x.isdigit():\\n        return None\\n' ELSE '' END,
 CASE WHEN stores THEN '    s = Store()\\n    t = s\\n    t.value = x\\n    s.save(x)\\n' ELSE '' END, CASE WHEN fn % 29 = 0 THEN '    n = 1\\n    n = "one"\\n' ELSE '' END,
 CASE WHEN helps THEN concat('    _h', fn, '(x, True)\\n') ELSE '' END,
 CASE WHEN asks THEN '    shared(x)\\n    only_here(x)\\n    nowhere(x)\\n' ELSE '' END,
 array_join(transform(callees, c -> concat('    f', c, '(x, cursor)\\n')), ''),
 CASE sink WHEN 0 THEN '    cursor.execute("SELECT " + x)\\n' WHEN 1 THEN '    os.system(x)\\n' ELSE '' END,
 '    return a\\n')"""
_JAVASCRIPT = """
concat(
 'import React from "react"\\n', array_join(transform(callees, c -> concat('import { f', c, ' } from "', CASE WHEN c % 5 = pkg THEN './' ELSE concat('../pkg', c % 5, '/') END, 'm', c, '"\\n')), ''),
 CASE WHEN fn % 7 = 0 THEN 'const one = new Function("return 1")\n' ELSE '' END, CASE WHEN fn % 3 = 0 THEN concat('const apiKey = "', secret, '"\\n') ELSE '' END,
 'export function f', fn, '(a, el) {\\n', CASE WHEN is_source THEN '  let x = location.search\\n' ELSE '  let x = a\\n' END,
 CASE WHEN sanitised THEN '  x = DOMPurify.sanitize(x)\\n' ELSE '' END,
 CASE WHEN guarded THEN '  if (!/^\\\\d+$/.test(x)) { return null }\\n' ELSE '' END,
 array_join(transform(callees, c -> concat('  f', c, '(x, el)\\n')), ''),
 CASE sink WHEN 0 THEN '  el.innerHTML = x\\n' WHEN 1 THEN '  eval(x)\\n' WHEN 2 THEN '  localStorage.setItem("auth_token", a)\\n' ELSE '' END,
 CASE WHEN fn % 5 = 0 THEN CASE WHEN sanitised THEN '  const html = sanitizeHtml(a)\\n  return <div dangerouslySetInnerHTML={{ __html: html }} />\\n' ELSE '  return <a href="javascript:void(0)"><b dangerouslySetInnerHTML={{ __html: a }} /> it\\'s</a>\\n' END ELSE '  return a\\n' END,
 '}\\n')"""
_GO = """
concat('package pkg', pkg, '\\n\\nimport (\\n\\t"fmt"\\n\\t"example.com/app/pkg', (fn + 1) % 5, '"\\n\\t"github.com/x/y', fn % 4, '"\\n)\\n\\ntype T', fn, ' struct {\\n\\tName string\\n}\\n\\nfunc (t *T', fn, ') F', fn, '(a, b int) error {\\n\\tfmt.Println(a)\\n\\treturn nil\\n}\\n')"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): a file a part."""
    python, javascript, go = (t.replace("{", "{{").replace("}", "}}") for t in (_PYTHON, _JAVASCRIPT, _GO))
    rows = spark.sql(
        "SELECT u.*, coalesce(c.callees, array()) AS callees FROM {units} u LEFT JOIN (SELECT caller, array_sort(collect_list(callee)) AS callees FROM {unit_calls} GROUP BY caller) c ON c.caller = u.fn",
        units=view(spark, sf_dir, "units"),
        unit_calls=view(spark, sf_dir, "unit_calls"),
    )
    # a fixed number of tasks, as rows are small before their text is written, and too few tasks would read all of it
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spark.sql(f"SELECT path, language, CASE language WHEN 'python' THEN {python} WHEN 'go' THEN {go} ELSE {javascript} END AS content FROM {{rows}}", rows=rows)
