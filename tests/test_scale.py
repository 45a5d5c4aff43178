"""What tasks hold and how work is dealt out: bounds that don't grow with the tables."""

import hashlib
import json
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from girder.code import python
from girder.operators import graph, incremental, source_code, triage
from girder.plans.operator import REGISTRY
from girder.queries import oracle_sql, queries
from girder.sources import cache, project, report
from girder.sources.codebase import source_files


def test_rows_of_few_files_are_held_at_a_time():
    """A task gives its rows on after FILES_AT_ONCE files, however many come in a batch."""
    held, read = source_code.FILES_AT_ONCE, []
    batch = pa.RecordBatch.from_pylist([{"path": f"m{k}.py", "language": "python", "content": "import os\n"} for k in range(2 * held + 5)])

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run(iter([batch]))

    def rows(path, m):
        read.append(path)
        yield from source_code._facts(path, m)

    out = source_code.mapped(Files(), source_code.FACTS, rows)
    assert next(out).num_rows == len(read) == held
    assert [b.num_rows for b in out] == [held, 5]


def test_files_are_read_by_as_many_tasks_as_shuffles_have(spark):
    """Rows of the tables are small before their text is written, and would meet in one task."""
    tasks = source_files(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_sql(name, sf="sf0.001"):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    return con.execute(oracle_sql()[name]).fetchall()


def test_every_sink_that_a_source_reaches(spark):
    """Not the nearest one alone: a source of this table has several sinks of a category, at several depths."""
    got = [tuple(r) for r in queries()["t_14_interprocedural"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(by_sql("t_14_interprocedural"))
    of_source = {}
    for source, function, _, sink, category, depth in got:
        of_source.setdefault((source, function, category), set()).add((sink, depth))
    assert max(map(len, of_source.values())) > 1


def test_budgets_count_the_nearest_paths(spark):
    got = [tuple(r) for r in queries()["o_09_bounded_budgets"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=repr) == sorted(by_sql("o_09_bounded_budgets"), key=repr)
    assert [r for r in got if r[0] == "paths" and r[2] > 0]


def test_sources_travel_together_and_rules_count_them(spark, monkeypatch):
    """200 sources go into f, over it to g and h: a round holds a row for each 64 of them, and every pair comes out."""
    held, save = {}, source_code.Scratch.save
    monkeypatch.setattr(source_code.Scratch, "save", lambda self, df, name: held.setdefault(name, save(self, df, name)))
    flow = lambda path, function, kind, origin_kind, origin, target="", position=0, category="", clean=0: (path, function, kind, origin_kind, origin, target, position, category, clean, 1)
    into = [flow(f"s{k}", "s", "argument", "source", "q", "f", 0, "", 4 if k % 2 else 0) for k in range(200)]
    rest = [flow("f", "f", "argument", "param", "0", "g"), flow("f", "f", "argument", "param", "0", "h", 1), flow("f", "f", "hit", "param", "0", "execute", 0, "SQL"), flow("g", "g", "argument", "param", "0", "h", 1), flow("h", "h", "hit", "param", "1", "innerHTML", 0, "DOM"), flow("h", "h", "hit", "param", "1", "execute", 0, "SQL")]
    summary = spark.createDataFrame(into + rest, source_code.FLOWS)
    sites = [(f"s{k}", "f", "f", "f") for k in range(200)] + [("f", "g", "g", "g"), ("f", "h", "h", "h"), ("g", "h", "h", "h")]
    resolved = spark.createDataFrame(sites, "path string, callee string, target_path string, target string")
    got = [tuple(r) for r in source_code.interprocedural(spark, summary, resolved).collect()]
    want = [(f"s{k}", "s", sink, sink, c, d) for k in range(200) for sink, c, d in (("f", "SQL", 1), ("h", "SQL", 2), ("h", "DOM", 2)) if c == "SQL" or k % 2 == 0]
    assert sorted(got) == sorted(want)
    rounds = {name: df.count() for name, df in held.items() if name.startswith("state-")}
    assert rounds and max(rounds.values()) < 200
    held.clear()
    assert sorted(map(tuple, source_code.sources_by_sink(spark, summary, resolved, "DOM").collect())) == [("h", "h", 100)]
    held.clear()
    assert sorted(map(tuple, source_code.sources_by_sink(spark, summary, resolved, "SQL").collect())) == [("f", "f", 200), ("h", "h", 200)]


def test_closure_changes_by_blocks(spark, monkeypatch):
    """600 nodes, so three blocks, with cycles; batches of few pairs."""
    monkeypatch.setattr(incremental, "PAIRS_AT_ONCE", 512)
    old = {(k, (k * 7 + 3) % 600) for k in range(0, 600, 2)} | {(k, k + 1) for k in range(590)} - {(300, 301)}
    new = old - {(100, 101), (13, 14)} | {(300, 301), (599, 5)}

    def closed(edges):
        then, out = {}, set()
        for a, b in edges:
            then.setdefault(a, []).append(b)
        for a in then:
            seen, todo = set(), list(then[a])
            while todo:
                if (b := todo.pop()) not in seen:
                    seen.add(b)
                    todo += then.get(b, ())
            out |= {(a, b) for b in seen}
        return out

    shifted = lambda edges: spark.createDataFrame([(10 * a, 10 * b) for a, b in edges], "a long, b long")  # noqa: E731  numbers need not be dense
    got = [tuple(r) for r in incremental.changed_blocks(shifted(old), shifted(new)).collect()]
    before, after = closed(old), closed(new)
    want = [(10 * a, 10 * b, c) for c, pairs in (("LOST", before - after), ("GAINED", after - before)) for a, b in pairs]
    assert {r[2] for r in got} == {"LOST", "GAINED"} and sorted(got) == sorted(want)
    empty = spark.createDataFrame([], "a long, b long")
    assert incremental.changed_blocks(empty, empty).collect() == []


def test_component_cycles_over_imports_both_ways(spark):
    got = [tuple(r) for r in queries()["arc_006_component_cycle"](spark, "/root/testdata/sf0.001").collect()]
    assert got and sorted(got) == sorted(by_sql("arc_006_component_cycle"))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_rows_of_a_workbook_with_their_sheets(spark, tmp_path, monkeypatch, size):
    """Lines belong to the range in which they begin, whatever the size of the ranges."""
    path = f"{tmp_path}/book.xlsx"
    sheets = {"Findings": ["<row r='1'/>", "<row r='2'>é</row>", "<row r='3'></row>"], "Findings 2": ["<row r='2'>b</row>"], "By file": ["x" * 200, "end"]}
    with zipfile.ZipFile(path, "w") as book:
        for k, lines in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{k}.xml", "\n".join(lines))
        for name, text in report._book(list(sheets)).items():
            book.writestr(name, text)
    monkeypatch.setattr(report, "BUFFER", size)
    assert sorted(map(tuple, report.sheet_lines(spark, path).collect())) == sorted((n, x) for n, lines in sheets.items() for x in lines)


def test_betweenness_takes_all_sources_in_few_batches(spark, monkeypatch):
    """The first batch shows how little a source meets; the second takes the rest, and batches change no value."""
    edges = spark.createDataFrame([(3 * k, 3 * k + 1) for k in range(80)] + [(3 * k + 1, 3 * k + 2) for k in range(80)], "a long, b long")
    nodes, saved, save = spark.range(240), [], graph.Scratch.save
    monkeypatch.setattr(graph.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    monkeypatch.setattr(graph, "SOURCES_AT_ONCE", 10)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, nodes).collect()}
    assert len([x for x in saved if x.startswith("level-") and x.endswith("-0")]) <= 2
    assert got == {k: round(1 / (239 * 238), 4) if k % 3 == 1 else 0.0 for k in range(240)}
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 60)  # many small batches
    small = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 3), (4, 1)]
    few, many = (sorted(map(tuple, graph.betweenness(spark.createDataFrame(small, "a long, b long"), spark.range(1, 6)).collect())) for _ in monkeypatch_sources(monkeypatch))
    assert few == many and max(r[1] for r in few) > 0


def monkeypatch_sources(monkeypatch):
    for n in (1000, 1):
        monkeypatch.setattr(graph, "SOURCES_AT_ONCE", n)
        yield n


def test_a_saved_baseline_is_read_by_lines(spark, tmp_path):
    """No row holds the document: a line is a finding, written by tasks and parsed by tasks."""
    one = 'file_path string, line int, col int, rule_id string, input_pos long, id string, severity string, category string, snippet string'
    rows = [(f"f{k % 7}", k, None if k % 5 == 0 else k % 3, "R", k, f"F{k}", "HIGH", "SECURITY", None if k == 3 else 'a"\n]}\r,') for k in range(60)]
    path = f"{tmp_path}/b.json"
    project.save_baseline(spark.createDataFrame(rows, one), path)
    held = json.loads(open(path).read())["findings"]
    assert [x["id"] for x in held] == [r[5] for r in sorted(rows, key=lambda r: (r[0], r[1]))] and spark.read.text(path).count() == 62
    got = project.baseline(spark, path).orderBy("input_pos").collect()
    assert [(r["id"], r["file_path"], r["line"], r["col"], r["snippet"]) for r in got] == [(r[5], r[0], r[1], r[2] or 0, r[8] or "") for r in sorted(rows, key=lambda r: (r[0], r[1]))]
    project.save_baseline(spark.createDataFrame([], one), path)
    assert project.baseline(spark, path).count() == 0
    (tmp_path / "cut.json").write_text(project.BASELINE_HEAD + "\n{}")
    with pytest.raises(project.Invalid):
        project.baseline(spark, str(tmp_path / "cut.json")).collect()


def test_reviews_of_no_finding_do_not_meet_in_one_task(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        featured = triage.features(spark.createDataFrame([("F1",), ("F2",)], "finding_id string"))
        reviews = spark.range(400).select(F.col("id").alias("review_id"), F.when(F.col("id") < 3, F.lit("F1")).alias("finding_id"), F.lit(" true_positive").alias("label")).repartition(4)
        rows = triage.captured(reviews, featured)
        of = rows.where("finding_id is null").groupBy(F.spark_partition_id()).count().collect()
        assert len(of) >= 4 and sum(r["count"] for r in of) == 397
        assert {(r["status"], r["n"]) for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()} == {("STORED", 3), ("UNKNOWN_FINDING", 397)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_call_strings_widen_beyond_eight(spark):
    """Two callers with four callers each make eight contexts; one caller more makes nine. Pairs are made for the former alone."""
    pairs = [(100 + k, 1) for k in range(4)] + [(200 + k, 2) for k in range(4)] + [(1, 7), (2, 7), (1, 8), (2, 8), (3, 8), (300, 3), (400, 1000)]
    calls = spark.createDataFrame([(a, b, p, 0) for a, b in pairs for p in (0, 1)], "caller long, callee long, from_param int, to_param int")
    got = {r["callee"]: (r["context"], r["n"]) for r in REGISTRY["t_15_call_strings"](spark, calls=calls).collect()}
    ctx = min(hashlib.sha256(f"{a}>{b}".encode()).hexdigest()[:16] for a, b in [(x, y) for x, y in pairs if y in (1, 2)])
    assert got == {7: (ctx, 8), 8: ("WIDENED", 9)}


def test_an_entry_moves_once_on_its_way_into_the_cache(spark, tmp_path, monkeypatch):
    seen, largest = [], cache.Cache._largest
    monkeypatch.setattr(cache.Cache, "_largest", lambda self, rows: seen.append(largest(self, rows)) or seen[-1])
    c = cache.Cache(spark, str(tmp_path))
    c.put("L8", spark.createDataFrame([("a", "1"), ("a", "22"), ("b", "3")], "key string, payload string"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert sorted(map(tuple, c.get("L8").collect())) == [("a", "22"), ("b", "3")]


def test_closure_in_words_and_what_a_change_does_to_it(spark):
    n = 80
    old = {(k, k + d) for d in (1, 9) for k in range(n - 9)} | {(50, 20)}
    new = (old - {(50, 20), (61, 62), (53, 62)}) | {(5, 75), (79, 3)}

    def plain(edges):
        to, out = {}, set()
        for a, b in edges:
            to.setdefault(a, []).append(b)
        for a in to:
            todo = list(to[a])
            while todo:
                if (a, b := todo.pop()) not in out:
                    out.add((a, b))
                    todo += to.get(b, [])
        return out

    frames = [spark.createDataFrame(sorted(x), "a long, b long") for x in (old, new)]
    closed = incremental.words(frames[0], "test-words")
    assert closed.count() <= 2 * n and {tuple(r) for r in incremental.pairs(closed).collect()} == plain(old)
    lost, gained = ({tuple(r) for r in x.collect()} for x in incremental.changed_words(*frames, closed))
    assert lost == plain(old) - plain(new) and gained == plain(new) - plain(old)


@pytest.mark.parametrize("name", ["c_09_composition", "c_08_postcondition_binding", "t_16_constant_branches", "a_20_resolution_stats", "j_06_import_resolution", "g_01_import_graph"])
def test_files_are_read_once_a_query(spark, monkeypatch, name):
    """All that a query asks of the texts comes from one reading, which is kept: nothing reads them again when the result is taken."""
    frame, read = type(spark.range(1)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: read.append(1) or plain(self, *a, **k))
    out = queries()[name](spark, "/root/testdata/sf0.001")
    assert len(read) == 1 and "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, by_sql(name)))


def test_an_import_is_looked_up_once_a_folder(spark, monkeypatch):
    asked, plain = [], source_code._by_group
    monkeypatch.setattr(source_code, "_by_group", lambda candidates, *a: asked.append(candidates) or plain(candidates, *a))
    files = spark.createDataFrame([(f"src/{d}/m{k}.py", "python", "from .near import x\nimport os, gone\n") for d in "ab" for k in range(30)] + [("src/a/near.py", "python", "")], "path string, language string, content string")
    got = {(r["path"][4], r["name"], r["category"], r["resolved"]) for r in source_code.python_imports(source_code.facts(files), files).collect()}
    assert got == {(d, "os", "STDLIB", None) for d in "ab"} | {(d, "gone", "EXTERNAL", None) for d in "ab"} | {("a", ".near", "LOCAL", "src/a/near.py"), ("b", ".near", "UNRESOLVED", None)}
    assert asked[0].select("folder", "name").distinct().count() == 6 and asked[0].groupBy("folder", "name", "ord").count().where("count > 1").count() == 0


def test_imports_are_read_without_expressions():
    text = "import os, a.b as c\nfrom ..x import y as z\ndef f():\n    try:\n        import t\n    except E:\n        from h import *\n    finally:\n        import w\nclass K:\n    match v:\n        case 1:\n            import m\n    for i in j:\n        with k:\n            import n\n    else:\n        import e\n"
    whole, alone = python.read(text), python.read_imports(text)
    assert alone.imports == whole.imports and len(alone.imports) == 9 and not alone.body and not alone.functions
    by_call = text + "q = __import__('late')\n"
    assert python.read_imports(by_call).imports == python.read(by_call).imports and python.read_imports("def broken(:\n").errors == python.read("def broken(:\n").errors


def test_a_call_that_two_imports_bind_and_names_of_other_objects(spark):
    """Each import that binds a name is followed; the own file comes first, then imports, then the one file that defines a name."""
    texts = {"a.py": "from b import g\nfrom gone import g\nimport b\ndef own():\n    own()\n    g()\n    b.g()\n    lone()\n    twice()\n    none()\n    b.none()\nclass K:\n    def m(self):\n        self.m()\n        self.n()\n", "b.py": "def g():\n    pass\ndef twice():\n    pass\n", "c.py": "def lone():\n    pass\ndef twice():\n    pass\n"}
    files = spark.createDataFrame([(p, "python", t) for p, t in texts.items()], "path string, language string, content string")
    f = source_code.facts(files)
    got = {(r["callee"], r["tier"], r["target_path"], r["target"]) for r in source_code.resolved_calls(f, source_code.all_imports(f, files)).collect()}
    assert got == {("own", "SAME_FILE", "a.py", "own"), ("g", "IMPORTED", "b.py", "g"), ("b.g", "MODULE", "b.py", "g"), ("lone", "UNIQUE", "c.py", "lone"), ("twice", "AMBIGUOUS", None, None), ("none", "MISSING_IMPORT", None, None), ("b.none", "EXTERNAL_MODULE", None, None), ("self.m", "METHOD", "a.py", "K.m"), ("self.n", "EXTERNAL_MODULE", None, None)}
