"""Operators over source text: facts, resolution of imports and calls, rules, taint within and across functions, control flow, objects, contracts.

Text is read once a query, a file a row, in Arrow batches; every analysis of one file is a function of its text. All that needs
more than one file (resolution, composition of summaries, orphans, verification) is relational over the extracted rows.
Queries run on the code base that ``sources.codebase`` writes from the base tables; their SQL follows from the relations behind it.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.code import cfg, contracts, flow, go, javascript, objects, python, rules
from girder.code.guards import conditions
from girder.code.ir import Module, calls, dotted, expressions, statements
from girder.code.registry import family, sanitizer_of, sink_of, source_of
from girder.functions.scalars import entropy
from girder.plans.operator import DUCK, native, view
from girder.plans.scratch import Scratch
from girder.sources.codebase import CATEGORY, source_files

BITS = {"SQL": 1, "COMMAND": 2, "DOM": 4, "EVAL": 8}
ALL_SAFE = 15
MOST_CALLS = 5


def parse(language: str, content: str) -> Module:
    """A source text as a module, by its language's adapter."""
    kind = family(language)
    if kind == "python":
        return python.read(content)
    if kind == "javascript":
        return javascript.read(content, language)
    if kind == "go":
        return go.read(content)
    return Module(language, errors=[("no reader for the language", 1)])


#: Files whose rows a task holds at a time.
FILES_AT_ONCE = 128


#: Containers that may come and go before the collector looks for cycles: trees of files hold none.
COLLECTED_AT = 100_000
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
Rows = Callable[[str, Module], Iterator[tuple]]


def _columns(schema: str) -> dict[str, str]:
    return dict(c.split() for c in schema.split(", "))


def _read(files: DataFrame, schema: str, parts: list[tuple[str | None, str, Rows]], read: Callable[[str, str], Module]) -> DataFrame:
    """The rows of parts (name, schema, rows) from one reading of every file, a batch a part; ``part`` names it, and columns of other parts are null."""
    whole = _columns(schema)
    dealt = [(name, {c: i for i, c in enumerate(_columns(own))}, rows) for name, own, rows in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = gc.get_threshold()
        gc.set_threshold(max(COLLECTED_AT, before[0]), *before[1:])
        try:
            for b in (x.slice(at, FILES_AT_ONCE) for x in batches for at in range(0, x.num_rows, FILES_AT_ONCE)):
                out: list[list[tuple]] = [[] for _ in dealt]
                for p, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    m = read(lang or "", text or "")
                    for held, (_, _, rows) in zip(out, dealt, strict=True):
                        held += [(p, *r) for r in rows(p, m)]
                for held, (name, place, _) in zip(out, dealt, strict=True):
                    cols = list(zip(*held, strict=True)) or [[]] * len(place)
                    n = len(held)
                    yield pa.RecordBatch.from_arrays([pa.array(cols[place[c]], KINDS[k]) if c in place else pa.array([name] * n if c == "part" else [None] * n, KINDS[k]) for c, k in whole.items()], list(whole))
        finally:
            gc.set_threshold(*before)

    return files.select("path", "language", "content").mapInArrow(run, schema)


def mapped(files: DataFrame, schema: str, rows: Rows, read: Callable[[str, str], Module] = parse) -> DataFrame:
    """The rows of every file (path, language, content); a null text is an empty one."""
    return _read(files, schema, [(None, schema, rows)], read)


def together(files: DataFrame, name: str, read: Callable[[str, str], Module] = parse, **parts: tuple[str, Rows]) -> list[DataFrame]:
    """What ``mapped`` gives for each part (schema, rows), from one reading of the files, which is kept."""
    schema = "part string, " + ", ".join(f"{c} {k}" for c, k in {c: k for own, _ in parts.values() for c, k in _columns(own).items()}.items())
    every = Scratch(files.sparkSession, name).save(_read(files, schema, [(part, *p) for part, p in parts.items()], read), name)
    return [every.where(F.col("part") == part).select(*_columns(own)) for part, (own, _) in parts.items()]


# extraction

#: Of a call ``tier`` and ``target`` if its own file defines what it calls, else ``module`` and ``target`` for each import that binds its name.
FACTS = "path string, kind string, scope string, name string, detail string, line int, end_line int, n int, tier string, module string, target string"
#: What resolution asks for.
RESOLVED = frozenset(("import", "function", "call"))


def _links(m: Module) -> Callable[[str, str], list[tuple]]:
    """(tier, module, target) of a call by its scope and name, as far as its own file tells."""
    own = {f.qualified for f in m.functions}
    bound: dict[str, list[tuple[str, str]]] = {}
    for i in m.imports:
        for a, b in i.names:
            bound.setdefault(b, []).append(("." * i.level + i.module, a))

    def of(scope: str, callee: str) -> list[tuple]:
        head, _, last = callee.rpartition(".")
        if head in ("self", "this") and (method := f"{scope.rpartition('.')[0]}.{last}") in own:
            return [("METHOD", None, method)]
        if not head and callee in own:
            return [("SAME_FILE", None, callee)]
        return [(None, module, last if head else a) for module, a in bound.get(head or callee, ())] or [(None, None, None)]

    return of


def _facts(path: str, m: Module, only: frozenset[str] | None = None) -> Iterator[tuple]:
    """Facts of all kinds, or of those that are asked for."""
    none = (None, None, None)
    for i in m.imports:
        yield "import", i.kind, "." * i.level + i.module, ",".join(f"{a}:{b}" for a, b in i.names), i.line, i.line, i.level, *none
    for f in m.functions:
        yield "function", f.owner, f.qualified, ",".join(p.name for p in f.params), f.line, f.end, len(f.params), *none
    links = _links(m)
    bodies = [("<module>", m.body), *[(f.qualified, f.body) for f in m.functions]]
    if only == RESOLVED:
        for scope, body in bodies:
            for e in calls(body):
                if callee := e.callee:
                    for link in links(scope, callee):
                        yield "call", scope, callee, e.kind, e.line, e.line, len(e.args), *link
        return
    for name, kind, line in m.exports:
        yield "export", "", name, kind, line, line, 0, *none
    for f in m.functions:
        for d in f.decorators:
            yield "decorator", f.qualified, dotted(d) or d.callee, "", f.line, f.line, 0, *none
    for c in m.classes:
        yield "class", "", c.name, ",".join(c.bases), c.line, c.end, len(c.fields), *none
    for what, line in m.errors:
        yield "error", "", what, "", line, line, 0, *none
    for scope, body in bodies:
        for e in calls(body):
            if e.callee:
                for link in links(scope, e.callee):
                    yield "call", scope, e.callee, e.kind, e.line, e.line, len(e.args), *link
                if known := sanitizer_of(m.language, e.callee):
                    yield "sanitizer", scope, known[0], "+".join(sorted(known[1])), e.line, e.line, 0, *none
                elif (sink := sink_of(m.language, e.callee)) and e.callee.rsplit(".", 1)[-1] not in ("innerHTML", "outerHTML"):
                    yield "sink", scope, sink[0], sink[1], e.line, e.line, sink[2], *none
                if source := source_of(m.language, e.callee, True):
                    yield "source", scope, source, "", e.line, e.line, 0, *none
        for s in statements(body):
            for t in s.targets:
                if t.kind == "attr" and t.name in ("innerHTML", "outerHTML"):
                    yield "sink", scope, t.name, "DOM", s.line, s.line, 0, *none
        for e in expressions(body):
            if e.kind == "attr" and (source := source_of(m.language, dotted(e), False)):
                yield "source", scope, source, "", e.line, e.line, 0, *none


def _resolving(path: str, m: Module) -> Iterator[tuple]:
    return _facts(path, m, RESOLVED)


def _importing(path: str, m: Module) -> Iterator[tuple]:
    return (r for r in _facts(path, Module(m.language, imports=m.imports)))


def parse_imports(language: str, content: str) -> Module:
    """A module of which only the imports are asked for."""
    return python.read_imports(content) if family(language) == "python" else parse(language, content)


def parse_choices(language: str, content: str) -> Module:
    """A module in which the statements of functions have values where they can hold True or False."""
    return python.read_marked(content, "True|False") if family(language) == "python" else parse(language, content)


def facts(files: DataFrame) -> DataFrame:
    return mapped(files, FACTS, _facts)


FLOWS = "path string, function string, kind string, origin_kind string, origin string, target string, position int, category string, clean int, line int"


def _flows(path: str, m: Module) -> Iterator[tuple]:
    bits = lambda clean: sum(BITS[c] for c in clean)
    for s in flow.summaries(m):
        for h in s.hits:
            kind, _, rest = h.origin.partition(":")
            yield s.function, "hit", kind, rest.partition("@")[0], h.sink, 0, h.category, 0, h.line
        for callee, line, position, origin, clean in s.arguments:
            kind, _, rest = origin.partition(":")
            yield s.function, "argument", kind, rest.partition("@")[0], callee, position, "", bits(clean), line
        for origin, w in s.returns.items():
            kind, _, rest = origin.partition(":")
            yield s.function, "return", kind, rest.partition("@")[0], "", 0, "", bits(w.clean), s.line
        for callee, line, position, value in s.constants:
            yield s.function, "constant", "constant", value, callee, position, "", 0, line


def _choices(path: str, m: Module) -> Iterator[tuple]:
    """The constants True and False that go into calls; a function without a call of one is not folded."""
    own = [f for f in m.functions if any(isinstance(a.value, bool) for e in calls(f.body) for a in e.args)]
    return (r for r in _flows(path, Module(m.language, functions=own, body=m.body)) if r[1] == "constant" and r[3] in ("True", "False"))


def flows(files: DataFrame) -> DataFrame:
    """Summaries of functions: hits of sinks, arguments of calls, results, each with its origin and what it is safe for as bits."""
    return mapped(files, FLOWS, _flows)


FINDINGS = "path string, rule_id string, severity string, line int, detail string"


def findings(files: DataFrame) -> DataFrame:
    return mapped(files, FINDINGS, lambda path, m: iter(rules.findings(m)))


GRAPHS = "path string, function string, blocks int, edges int, paths int, infeasible int, widened int, truncated int, guards int"


def _graphs(path: str, m: Module) -> Iterator[tuple]:
    for f in m.functions:
        g = cfg.build(f)
        x = cfg.explore(g)
        yield f.qualified, len(g.blocks), len(g.edges), len(x.paths), x.infeasible, x.widened, x.truncated, x.guards


EDGES = "path string, function string, source int, target int, kind string"


def _edges(path: str, m: Module) -> Iterator[tuple]:
    for f in m.functions:
        for e in cfg.build(f).edges:
            yield f.qualified, e.source, e.target, e.kind


GUARDS = "path string, function string, variable string, op string, literal string, fact string, line int"


def _guards(path: str, m: Module) -> Iterator[tuple]:
    """Conditions as they hold on the true side, and the facts that either side gives."""
    for f in m.functions:
        for s in statements(f.body):
            if s.kind in ("if", "loop") and s.value is not None and not s.targets:
                held, known = conditions(s.value, True)
                other = conditions(s.value, False)
                for c in held or other[0]:
                    yield f.qualified, c.variable, c.op, c.literal, "+".join(sorted({x.kind for x in [*known, *other[1]]})), s.line


OBJECTS = "path string, function string, kind string, name string, detail string, line int"
USES = "path string, scope string, name string, line int, defined int, owner string"


# resolution

#: Extensions that a JavaScript specifier may leave out, modules that come with Node, and roots of Python sources.
EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
NODE = ("assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "http2", "https", "net", "os", "path", "process", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib")
ROOTS = ("src", "lib")


def normal(path: Column) -> Column:
    """A path without . and .. segments."""
    start = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        return F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def _first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, resolved): of the candidates (path, name, ord, cand) the first that is a file."""
    known = files.select(F.col("path").alias("cand")).distinct()
    return candidates.join(known, "cand").groupBy("path", "name").agg(F.min_by("cand", "ord").alias("resolved"))


def _by_group(candidates: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """(key, resolved): of the candidates (key, ord, cand) the first that is a file."""
    known = files.select(F.col("path").alias("cand")).distinct()
    return candidates.join(known, "cand").groupBy(*key).agg(F.min_by("cand", "ord").alias("resolved"))


def python_imports(f: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, category, resolved) for each Python import: candidates in order, the first that is a file wins.

    What an import means is the same for all files of a folder, so it is looked up once for each folder.
    """
    every = f.where("kind = 'import' and path like '%.py'").select("path", "name", "detail", F.col("n").alias("level"))
    every = every.groupBy("path", "name", "level").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("detail", ","))))).alias("parts"))
    every = every.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    key = ["folder", "name", "level", "parts"]
    asked = every.select(*key).distinct()
    folder, bare = F.col("folder"), F.expr("substr(name, level + 1)")
    inner = F.replace(bare, F.lit("."), F.lit("/"))
    up = F.when(F.col("level") > 0, normal(F.concat(folder, F.expr("repeat('/..', level - 1)"), F.lit("/"), inner))).otherwise(inner)
    names = F.transform("parts", lambda p: F.concat(F.lit("/"), F.split(p, ":")[0], F.lit(".py")))
    places = [up, *[F.when(F.col("level") == 0, F.concat(x, F.lit("/"), inner)) for x in (folder, *map(F.lit, ROOTS))]]
    own = [c for x in places for c in (F.concat(x, F.lit(".py")), F.concat(x, F.lit("/__init__.py")))]
    cands = F.concat(F.array(*own[:2]), F.transform(names, lambda n: F.concat(up, n)), F.array(*own[2:]), *[F.transform(names, lambda n, x=x: F.concat(x, n)) for x in places[1:]])
    each = asked.select(*key, F.posexplode(F.filter(F.array_distinct(cands), lambda c: c.isNotNull())).alias("ord", "cand"))
    hit = _by_group(each, key, files)
    std = f.sparkSession.createDataFrame([(x,) for x in sorted(sys.stdlib_module_names)], "root string")
    words = files.select(F.explode(F.split(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "/")).alias("root")).distinct().withColumn("near", F.lit(True))
    out = asked.withColumn("root", F.regexp_extract("name", r"^\.*([^.]*)", 1)).join(hit, key, "left")
    # the list of the language's own modules has a fixed length
    out = out.join(F.broadcast(std.withColumn("std", F.lit(True))), "root", "left").join(words, "root", "left")
    category = F.when((F.col("level") == 0) & F.col("std"), "STDLIB").when(F.col("resolved").isNotNull(), "LOCAL").when((F.col("level") > 0) | F.col("near"), "UNRESOLVED").otherwise("EXTERNAL")
    out = out.select(*key, category.alias("category"), F.when(category == "LOCAL", F.col("resolved")).alias("resolved"))
    return every.join(out, key).select("path", "name", "category", "resolved")


def javascript_imports(f: DataFrame, files: DataFrame, aliases: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(path, name, category, resolved); aliases: (prefix of a specifier, folder), as a project file maps them."""
    every = f.where(r"kind = 'import' and path rlike '\\.(m?jsx?|tsx?)$'").select("path", "name").distinct()
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    mapped_to = F.lit(None).cast("string")
    for prefix, to in reversed(aliases):
        mapped_to = F.when(F.col("name").startswith(prefix), F.concat(F.lit(to), F.expr(f"substr(name, {len(prefix) + 1})"))).otherwise(mapped_to)
    base = F.when(F.col("name").startswith("."), normal(F.concat(folder, F.lit("/"), "name"))).otherwise(F.coalesce(mapped_to, F.col("name")))
    cands = F.array(base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS])
    hit = _first(every.select("path", "name", F.posexplode(cands).alias("ord", "cand")), files)
    own = F.regexp_replace("name", "^node:", "").isin(*NODE) | F.col("name").startswith("node:")
    category = F.when(own, "STDLIB").when(F.col("resolved").isNotNull(), "LOCAL").when(F.col("name").startswith("."), "UNRESOLVED").otherwise("EXTERNAL")
    return every.join(hit, ["path", "name"], "left").select("path", "name", category.alias("category"), F.when(category == "LOCAL", F.col("resolved")).alias("resolved"))


def go_imports(f: DataFrame, module: str, vendored: str = "vendor/") -> DataFrame:
    """(path, name, category); a first segment without a dot is the language's own."""
    every = f.where("kind = 'import' and path like '%.go'").select("path", "name").distinct()
    local = (F.col("name") == module) | F.col("name").startswith(module + "/")
    category = F.when(local, "LOCAL").when(F.col("name").startswith(vendored), "VENDORED").when(~F.split("name", "/")[0].contains("."), "STDLIB").otherwise("EXTERNAL")
    return every.select("path", "name", category.alias("category"))


def resolved_calls(f: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, scope, callee, line, tier, target_path, target) for each call.

    Tiers in order: a method of the own object, a function of the same file, an imported name, a function of an imported
    module, a name that one file alone defines; else AMBIGUOUS, EXTERNAL_MODULE for a dotted name and MISSING_IMPORT.
    """
    key = ["path", "scope", "callee", "line"]
    sites = f.where("kind = 'call'").select("path", "scope", F.col("name").alias("callee"), "line", "tier", "module", "target").distinct()
    functions = f.where("kind = 'function'").select(F.col("path").alias("target_path"), F.col("name").alias("g")).distinct()
    bare = ~F.col("callee").contains(".")
    arm = lambda df, ord_, tier, target_path: df.select(*key, F.struct(ord_.alias("ord"), tier.alias("tier"), target_path.alias("target_path"), F.col("target")).alias("hit"))
    own = arm(sites, F.when(F.col("tier") == "METHOD", 0).otherwise(1), F.col("tier"), F.col("path")).withColumn("hit", F.when(F.col("hit.tier").isNotNull(), F.col("hit")))
    local = imports.where("resolved is not null").select("path", F.col("name").alias("module"), "resolved")
    linked = sites.where("module is not null").join(local, ["path", "module"]).join(functions, (F.col("resolved") == F.col("target_path")) & (F.col("target") == F.col("g")))
    met = own.union(arm(linked, F.when(bare, 2).otherwise(3), F.when(bare, "IMPORTED").otherwise("MODULE"), F.col("target_path"))).groupBy(*key).agg(F.min("hit").alias("hit"))
    met = met.select(*key, "hit.tier", "hit.target_path", "hit.target")
    # only what no file of its own or of its imports defines is looked for everywhere
    everywhere = functions.where("g not like '%.%'").groupBy("g").agg(F.count("*").alias("n"), F.min("target_path").alias("only"))
    one, rest = F.col("n") == 1, F.when(F.col("callee").contains("."), "EXTERNAL_MODULE").otherwise("MISSING_IMPORT")
    last = met.where("tier is null").select(*key).join(everywhere, bare & (F.col("callee") == F.col("g")), "left")
    last = last.select(*key, F.when(one, "UNIQUE").when(F.col("n") > 1, "AMBIGUOUS").otherwise(rest).alias("tier"), F.when(one, F.col("only")).alias("target_path"), F.when(one, F.col("g")).alias("target"))
    return met.where("tier is not null").union(last)


def linked_calls(links: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, callee, target_path, target): what ``resolved_calls`` finds, once for each file and name; calls that lead nowhere are left out.

    Only names that a file binds more than once are grouped; all others have one row by the reading of their file.
    """
    functions = functions.select(F.col("path").alias("target_path"), F.col("name").alias("g")).distinct()
    own = links.where("tier is not null").select("path", "callee", F.col("path").alias("target_path"), "target")
    local = imports.where("resolved is not null").select("path", F.col("name").alias("module"), "resolved")
    rest = links.where("tier is null").select("path", "callee", "module", "target", "links").join(local, ["path", "module"], "left")
    rest = rest.join(functions, (F.col("resolved") == F.col("target_path")) & (F.col("target") == F.col("g")), "left").select("path", "callee", "links", "target_path", F.when(F.col("g").isNotNull(), F.col("target")).alias("target"))
    many = rest.where("links > 1").groupBy("path", "callee").agg(F.min(F.when(F.col("target").isNotNull(), F.struct("target_path", "target"))).alias("hit")).select("path", "callee", "hit.target_path", "hit.target")
    met = Scratch(links.sparkSession, "linked").save(rest.where("links = 1").drop("links").union(many), "linked")
    everywhere = functions.where("g not like '%.%'").groupBy("g").agg(F.count("*").alias("n"), F.min("target_path").alias("only")).where("n = 1")
    last = met.where("target is null and not contains(callee, '.')").join(everywhere, F.col("callee") == F.col("g")).select("path", "callee", F.col("only").alias("target_path"), F.col("g").alias("target"))
    return own.union(met.where("target is not null")).union(last)


def _targets(resolved: DataFrame) -> DataFrame:
    """(path, callee, target_path, target), once each if ``resolved`` has a row a call."""
    found = resolved.where("target is not null").select("path", "callee", "target_path", "target")
    return found.distinct() if "line" in resolved.columns else found


def all_imports(f: DataFrame, files: DataFrame) -> DataFrame:
    return python_imports(f, files).unionByName(javascript_imports(f, files))


def orphan_exports(f: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name): exports that nothing imports. An import of a whole module takes all its exports; files where programs begin are exempt."""
    exports = f.where("kind = 'export' and name <> '*' and name not like '\\_%'").select("path", "name", "detail").distinct()
    exports = exports.where(~F.col("path").rlike(r"(^|/)(main|app|manage|setup|conftest|__init__|__main__)\.py$|(^|/)index\.[a-z]+$|(^|/)tests?/|(^|/)test_|_test\.|\.spec\.|\.test\."))
    used = f.where("kind = 'import'").select(F.col("path").alias("p"), F.col("name").alias("module"), F.explode(F.split("detail", ",")).alias("pair"))
    used = used.join(imports.where("resolved is not null").select(F.col("path").alias("p"), F.col("name").alias("module"), "resolved"), ["p", "module"]).select("resolved", F.split("pair", ":")[0].alias("what"), "module")
    whole = used.where("what in ('*', '') or what = module").select("resolved").distinct()
    named = used.select("resolved", "what").distinct()
    out = exports.join(whole, F.col("path") == F.col("resolved"), "left_anti")
    same = (F.col("path") == F.col("resolved")) & ((F.col("name") == F.col("what")) | ((F.col("detail") == "default") & (F.col("what") == "default")))
    return out.join(named, same, "left_anti").select("path", "name")


# taint across functions


def _reached(spark: SparkSession, summary: DataFrame, resolved: DataFrame, most: int, wanted: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What sources reach: (sink, category, word, d1 ... of ``most``), (sink, sink_path, sink_function) and (word, bit, source_path, source_function).

    Sources are numbered; a row holds 64 of them as the bits of a word, in ``d1`` those that come to the sink over one call, in ``d2``
    over two, and so on. ``wanted``: the categories (bits) that are asked for. A state is (the function and parameter that sources have come
    to, what they are safe for on the way, a word of sources). Rounds follow calls, at most ``most`` deep, to parameters that still lead to a
    sink in the calls that are left; what was met before, or is safe for all that is wanted, is not followed.
    """
    scratch = Scratch(spark, "interprocedural")
    summary = summary.withColumnRenamed("target", "callee")
    bit = F.element_at(F.create_map(*[F.lit(x) for p in BITS.items() for x in p]), F.col("category"))
    unsafe = lambda mask: mask.bitwiseAND(wanted) != wanted
    targets = scratch.save(_targets(resolved), "targets")
    # results that carry a source: a call of such a function is a source where it stands
    gives = summary.where("kind = 'return' and origin_kind = 'source'").groupBy(F.col("path").alias("target_path"), F.col("function").alias("target")).agg(F.min("clean").alias("given"))
    of_calls = scratch.save(summary.where("origin_kind = 'call'"), "of-calls")
    meant = targets.withColumnRenamed("callee", "origin")
    passed = of_calls.where("kind = 'return'").join(meant, ["path", "origin"]).select("path", "function", "clean", "target_path", "target")
    passed, gives = scratch.save(passed, "passed"), scratch.save(gives, "gives-0")
    for k in range(1, 3):
        more = passed.join(gives, ["target_path", "target"]).select(F.col("path").alias("target_path"), F.col("function").alias("target"), F.col("clean").bitwiseOR(F.col("given")).alias("given"))
        gives = scratch.save(gives.union(more).groupBy("target_path", "target").agg(F.min("given").alias("given")), f"gives-{k}")
    called = scratch.save(meant.join(gives, ["target_path", "target"]), "giving").join(of_calls, ["path", "origin"])
    called = scratch.save(called.select(F.col("target_path").alias("source_path"), F.col("target").alias("source_function"), *summary.columns, "given"), "called")
    # parameters that meet a sink or go on, numbered; calls between them by their numbers
    gone_on = summary.where("kind = 'argument' and origin_kind = 'param'").where(unsafe(F.col("clean"))).withColumn("param", F.col("origin").cast("int"))
    hits = summary.where("kind = 'hit' and origin_kind = 'param'").where(bit.bitwiseAND(wanted) > 0)
    live = hits.select("path", "function", F.col("origin").cast("int").alias("param"), bit.alias("meets")).union(gone_on.select("path", "function", "param", F.lit(0)))
    live = live.groupBy("path", "function", "param").agg(F.bit_or("meets").alias("meets"))
    live = scratch.save(live.withColumn("id", F.monotonically_increasing_id()), "live")
    key, at = ["path", "callee", "position"], ["clean", "a", "source_path", "source_function"]
    no_id, no_name = F.lit(None).cast("long").alias("a"), [F.lit(None).cast("string").alias(c) for c in at[2:]]
    inner = gone_on.join(live.select("path", "function", "param", F.col("id").alias("a")), ["path", "function", "param"]).select(*key, "clean", "a", *no_name)
    first = summary.where("kind = 'argument' and origin_kind = 'source'").select(*key, "clean", no_id, F.col("path").alias("source_path"), F.col("function").alias("source_function"))
    carried = called.where("kind = 'argument'").select(*key, F.col("clean").bitwiseOR(F.col("given")).alias("clean"), no_id, "source_path", "source_function")
    named = targets.join(live.select(F.col("path").alias("target_path"), F.col("function").alias("target"), F.col("param").alias("position"), F.col("id").alias("b")), ["target_path", "target"]).select(*key, "b")
    edges = inner.union(first).union(carried).withColumn("clean", F.col("clean").bitwiseAND(wanted)).where(unsafe(F.col("clean"))).join(named, key).select(*at, "b")
    edges = scratch.save(edges, "edges")
    steps = scratch.save(edges.where("a is not null").select("a", "b", "clean").distinct(), "steps")
    # calls that are left between a parameter and the nearest sink
    near = far = scratch.save(live.where("meets > 0").select("id", F.lit(0).alias("left")), "near-0")
    for k in range(1, most):
        met = steps.join(far.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct()
        far = scratch.save(met.join(near, "id", "left_anti").withColumn("left", F.lit(k)), f"near-{k}")
        if not far.take(1):
            break
        near = near.union(far)
    near = near.withColumnRenamed("id", "b")
    steps = scratch.save(steps.join(near, "b"), "led")
    # sources and sinks, numbered: sources whose names lie close share a word
    back = called.where("kind = 'hit'").where(bit.bitwiseAND(wanted) > 0).where(F.col("given").bitwiseAND(bit) == 0).select("source_path", "source_function", F.col("path").alias("sink_path"), F.col("function").alias("sink_function"), bit.alias("category"))
    begin = edges.where("a is null").join(near, "b").select("source_path", "source_function", F.col("b").alias("id"), F.col("clean").alias("mask"))
    sources = begin.select("source_path", "source_function").union(back.select("source_path", "source_function")).distinct().orderBy(F.length("source_path"), "source_path", "source_function").withColumn("n", F.monotonically_increasing_id())
    sources = scratch.save(sources.select("source_path", "source_function", F.shiftright("n", 6).alias("word"), F.col("n").bitwiseAND(63).cast("int").alias("bit")), "sources")
    own = F.expr("shiftleft(1L, bit)")
    sinks = live.where("meets > 0").select(F.col("path").alias("sink_path"), F.col("function").alias("sink_function")).union(back.select("sink_path", "sink_function")).distinct()
    sinks = scratch.save(sinks.withColumn("sink", F.monotonically_increasing_id()), "sinks")
    by = ["id", "mask", "word"]
    state = begin.join(sources, ["source_path", "source_function"]).groupBy(*by).agg(F.bit_or(own).alias("new")).withColumn("old", F.lit(0).cast("long"))
    fronts = [state := scratch.save(state, "state-1")]
    for k in range(2, most + 1):
        front = state.where("new <> 0").select(F.col("id").alias("a"), "mask", "word", "new")
        on = steps.where(F.col("left") <= most - k).join(front, "a").select(F.col("b").alias("id"), F.col("mask").bitwiseOR(F.col("clean")).alias("mask"), "word", "new", F.lit(0).cast("long").alias("old")).where(unsafe(F.col("mask")))
        had = state.select(*by, F.lit(0).cast("long").alias("new"), F.col("old").bitwiseOR(F.col("new")).alias("old"))
        both = on.union(had).groupBy(*by).agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        state = scratch.save(both.select(*by, F.expr("new & ~old").alias("new"), "old"), f"state-{k}")
        fronts.append(state)
    # sinks that sources meet, by the calls on the way
    meets = live.where("meets > 0").join(sinks, (F.col("path") == F.col("sink_path")) & (F.col("function") == F.col("sink_function"))).select("id", "meets", "sink")
    meets = scratch.save(meets, "meets")
    hit = back.join(sinks, ["sink_path", "sink_function"]).join(sources, ["source_path", "source_function"]).select("sink", "category", "word", F.lit(1).alias("depth"), own.alias("bits"))
    for k, front in enumerate(fronts, 1):
        each = front.where("new <> 0").join(meets, "id").select("sink", F.explode(F.filter(F.array(*map(F.lit, BITS.values())), lambda b: F.col("meets").bitwiseAND(b).bitwiseAND(F.bitwise_not("mask")) > 0)).alias("category"), "word", F.lit(k).alias("depth"), F.col("new").alias("bits"))
        hit = hit.union(each)
    hit = hit.groupBy("sink", "category", "word").agg(*[F.coalesce(F.bit_or(F.when(F.col("depth") == k, F.col("bits"))), F.lit(0).cast("long")).alias(f"d{k}") for k in range(1, most + 1)])
    return hit, sinks, sources


def interprocedural(spark: SparkSession, summary: DataFrame, resolved: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """(source_path, source_function, sink_path, sink_function, category, depth): sources that reach sinks of other functions.

    Pairs of a source and a sink are made last, when no more is dealt out. ``summary`` is read several times.
    """
    met, sinks, sources = _reached(spark, summary, resolved, most, ALL_SAFE)
    names = sources.groupBy("word").agg(F.collect_list(F.struct("bit", "source_path", "source_function")).alias("names"))
    whole = " | ".join(f"d{k}" for k in range(1, most + 1))
    each = met.join(sinks, "sink").join(names, "word").withColumn("s", F.explode(F.expr(f"filter(names, s -> getbit({whole}, s.bit) = 1)")))
    depth = F.expr("CASE " + " ".join(f"WHEN getbit(d{k}, s.bit) = 1 THEN {k}" for k in range(1, most + 1)) + " END")
    category = F.element_at(F.create_map(*[F.lit(x) for c, b in BITS.items() for x in (b, c)]), F.col("category"))
    return each.select("s.source_path", "s.source_function", "sink_path", "sink_function", category.alias("category"), depth.alias("depth"))


def sources_by_sink(spark: SparkSession, summary: DataFrame, resolved: DataFrame, category: str, most: int = MOST_CALLS) -> DataFrame:
    """(sink_path, sink_function, paths): how many sources reach each sink of a category, counted without a row for each."""
    met, sinks, _ = _reached(spark, summary, resolved, most, BITS[category])
    whole = " | ".join(f"d{k}" for k in range(1, most + 1))
    n = met.groupBy("sink").agg(F.sum(F.expr(f"bit_count({whole})")).cast("long").alias("paths"))
    return n.join(sinks, "sink").select("sink_path", "sink_function", "paths")


def preconditions(summary: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, function, callee_path, callee, category, state) for each call of a function that needs its parameter safe.

    VIOLATED: a source goes in that is not safe for it; SATISFIED: all that goes in is; without proof either way UNKNOWN.
    """
    needs = summary.where("kind = 'hit' and origin_kind = 'param'").select(F.col("path").alias("callee_path"), F.col("function").alias("callee"), F.col("origin").cast("int").alias("i"), "category").distinct()
    # most calls lead to functions that need nothing
    needy = _targets(resolved).withColumnsRenamed({"path": "p", "callee": "c"}).join(needs, (F.col("target_path") == F.col("callee_path")) & (F.col("target") == F.col("callee"))).select("p", "c", "callee_path", "callee", "i", "category")
    given = summary.where("kind = 'argument'").select("path", "function", F.col("target").alias("called"), "position", "clean", "origin_kind")
    met = given.join(needy, (F.col("path") == F.col("p")) & (F.col("called") == F.col("c")) & (F.col("position") == F.col("i")))
    bit = F.element_at(F.create_map(*[F.lit(x) for p in BITS.items() for x in p]), F.col("category"))
    safe = F.col("clean").bitwiseAND(bit) > 0
    state = F.when(F.max(~safe & (F.col("origin_kind") == "source")), "VIOLATED").when(F.min(safe), "SATISFIED").otherwise("UNKNOWN")
    return met.groupBy("path", "function", "callee_path", "callee", "category").agg(state.alias("state"))


# queries


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language): the files of the code base without their text."""
    return view(spark, sf_dir, "units").select("path", "language")


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, facts) of the code base, facts extracted once."""
    return _listed(spark, sf_dir), Scratch(spark, "facts").save(facts(source_files(spark, sf_dir)), "facts")


def _imported(spark: SparkSession, sf_dir: str, where: str) -> tuple[DataFrame, DataFrame]:
    """(files, facts) with the imports of some files alone."""
    files = source_files(spark, sf_dir).where(where)
    return _listed(spark, sf_dir), Scratch(spark, "imports").save(mapped(files, FACTS, _importing, parse_imports), "imports")


def _resolution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, f = _saved(spark, sf_dir)
    return files, f, all_imports(f, files)


def _calls_and(spark: SparkSession, sf_dir: str, **parts: tuple[str, Rows]) -> tuple[DataFrame, ...]:
    """(resolved calls, rows of each part) from one reading of the code base."""
    f, *rest = together(source_files(spark, sf_dir), "resolution", facts=(FACTS, _resolving), **parts)
    return resolved_calls(f, all_imports(f, _listed(spark, sf_dir))), *rest


LINKS = "path string, callee string, tier string, module string, target string, links int"


def _linking(path: str, m: Module) -> Iterator[tuple]:
    """What the names that a file calls may mean, each once; ``links``: how many meanings a name has."""
    of, seen = _links(m), set()
    for scope, body in [("<module>", m.body), *[(f.qualified, f.body) for f in m.functions]]:
        for callee in {e.callee for e in calls(body) if e.callee}:
            found = of(scope, callee)
            seen |= {(callee, *x, len(set(found))) for x in found}
    return iter(sorted(seen, key=str))


def _named(path: str, m: Module) -> Iterator[tuple]:
    """Imports and functions."""
    return _facts(path, Module(m.language, imports=m.imports, functions=[replace(f, body=[]) for f in m.functions]), RESOLVED)


def _links_and(spark: SparkSession, sf_dir: str, **parts: tuple[str, Rows]) -> tuple[DataFrame, ...]:
    """(linked calls, rows of each part) from one reading of the code base."""
    f, links, *rest = together(source_files(spark, sf_dir), "links", facts=(FACTS, _named), links=(LINKS, _linking), **parts)
    return linked_calls(links, f.where("kind = 'function'"), all_imports(f, _listed(spark, sf_dir))), *rest


_COUNTS = "SELECT u.path, CAST({imports} AS BIGINT) AS imports, CAST({functions} AS BIGINT) AS functions, CAST({classes} AS BIGINT) AS classes, CAST({exports} AS BIGINT) AS exports, CAST(0 AS BIGINT) AS errors FROM {{units}} u LEFT JOIN (SELECT caller, count(*) AS n FROM {{unit_calls}} GROUP BY caller) c ON c.caller = u.fn WHERE u.language = '{language}'"
_B = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"


def _counted(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    f = facts(source_files(spark, sf_dir).where(F.col("language") == language))
    return f.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s" if k != "class" else "classes") for k in ("import", "function", "class", "export", "error")])


@native("s_04_python_facts", "units", "unit_calls", sql=_COUNTS.format(language="python", imports=f"2 + coalesce(c.n, 0) + {_B('u.fn % 6 = 0')} + {_B('u.fn % 21 = 0 OR u.fn % 22 = 0')}", functions=f"1 + {_B('u.helps')} + {_B('u.shares')} + {_B('u.fn = 1')} + {_B('u.stores')}", classes=_B("u.stores"), exports=f"1 + {_B('u.shares')} + {_B('u.fn = 1')} + 2 * {_B('u.stores')}"))
def s_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "python")


@native("s_05_javascript_facts", "units", "unit_calls", sql=_COUNTS.format(language="javascript", imports="1 + coalesce(c.n, 0)", functions="1", classes="0", exports="1"))
def s_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "javascript")


@native("s_06_go_facts", "units", "unit_calls", sql=_COUNTS.format(language="go", imports="3", functions="1", classes="1", exports="2"))
def s_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "go")


@native("s_07_language_adapters", "units", sql="SELECT language, count(*) AS files, CAST(0 AS BIGINT) AS unreadable FROM {units} GROUP BY language")
def s_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the adapter that read them."""
    files = source_files(spark, sf_dir)
    bad = facts(files).where("kind = 'error'").groupBy("path").agg(F.count("*").alias("e"))
    return files.select("path", "language").join(bad, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.count("e").alias("unreadable"))


@native("t_20_functions", "units", sql="SELECT path, concat(CASE WHEN language = 'go' THEN concat('T', CAST(fn AS VARCHAR), '.F') ELSE 'f' END, CAST(fn AS VARCHAR)) AS qualified_name, CASE language WHEN 'python' THEN 'a,cursor' WHEN 'go' THEN 'a,b' ELSE 'a,el' END AS params FROM {units} UNION ALL SELECT path, concat('_h', CAST(fn AS VARCHAR)), 'v,flag' FROM {units} WHERE helps UNION ALL SELECT path, 'shared', 'v' FROM {units} WHERE shares UNION ALL SELECT path, 'only_here', 'v' FROM {units} WHERE fn = 1 UNION ALL SELECT path, 'Store.save', 'self,v' FROM {units} WHERE stores")
def t_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(source_files(spark, sf_dir)).where("kind = 'function'").select("path", F.col("name").alias("qualified_name"), F.col("detail").alias("params"))


_PY, _JS = "language = 'python'", "language = 'javascript'"
_SECRET = f"round(CAST({entropy(DUCK, 'secret')} AS DOUBLE), 3) >= 3.8"
_OWN = "is_source AND sink_bit = {bit} AND (clean & {bit}) = 0"
_RULES = {
    "sec_py_001_source": ("SEC-PY-001", "units", f"{_PY} AND fn % 10 = 0 AND {_SECRET}"),
    "sec_py_002_debug": ("SEC-PY-002", "units", f"{_PY} AND fn % 25 = 0"),
    "sec_py_003_subprocess": ("SEC-PY-003", "units", f"{_PY} AND sink = 1"),
    "sec_py_004_eval": ("SEC-PY-004", "units", f"{_PY} AND fn % 19 = 0"),
    "sec_py_005_sql": ("SEC-PY-005", "units", f"{_PY} AND sink = 0"),
    "sec_py_006_weak_hash": ("SEC-PY-006", "units", f"{_PY} AND fn % 21 = 0"),
    "sec_py_007_cors": ("SEC-PY-007", "units", f"{_PY} AND fn % 23 = 0"),
    "sec_py_008_csrf": ("SEC-PY-008", "units", f"{_PY} AND fn % 26 = 0"),
    "sec_py_009_sql_dataflow": ("SEC-PY-009", "unit_taint", _OWN.format(bit=1)),
    "sec_py_010_command_dataflow": ("SEC-PY-010", "unit_taint", _OWN.format(bit=2)),
    "sec_js_001_eval": ("SEC-JS-001", "units", f"{_JS} AND sink = 1"),
    "sec_js_002_function": ("SEC-JS-002", "units", f"{_JS} AND fn % 7 = 0"),
    "sec_js_003_inner_html": ("SEC-JS-003", "units", f"{_JS} AND fn % 5 = 0 AND NOT sanitised"),
    "sec_js_004_client_secrets": ("SEC-JS-004", "units", f"{_JS} AND fn % 3 = 0 AND {_SECRET}"),
    "sec_js_005_unsafe_url": ("SEC-JS-005", "units", f"{_JS} AND fn % 5 = 0 AND NOT sanitised"),
    "sec_js_006_storage": ("SEC-JS-006", "units", f"{_JS} AND sink = 2"),
    "sec_js_007_dom_dataflow": ("SEC-JS-007", "unit_taint", _OWN.format(bit=4)),
    "sec_js_008_eval_dataflow": ("SEC-JS-008", "unit_taint", _OWN.format(bit=8)),
}
for _id, (_rule, _from, _where) in _RULES.items():

    @native(_id, _from, sql=f"SELECT path, CAST(1 AS BIGINT) AS n FROM {{{_from}}} WHERE {_where}")
    def _found(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        return findings(source_files(spark, sf_dir)).where(F.col("rule_id") == rule).groupBy("path").agg(F.count("*").alias("n"))


@native("sec_go_rules", "units", sql="SELECT path FROM {units} WHERE false")
def sec_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Go rules read the Go files and report nothing."""
    return findings(source_files(spark, sf_dir).where("language = 'go'")).select("path")


# matches of the registries


@native("t_02_source_match", "units", sql="SELECT path, CASE language WHEN 'python' THEN 'request.args' ELSE 'location.search' END AS source FROM {units} WHERE is_source AND language <> 'go'")
def t_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(source_files(spark, sf_dir)).where("kind = 'source'").select("path", F.col("name").alias("source"))


@native(
    "t_03_sink_match",
    "units",
    sql="SELECT path, sink, category, count(*) AS n FROM (SELECT path, 'execute' AS sink, 'SQL' AS category FROM {units} WHERE language = 'python' AND sink = 0 UNION ALL SELECT path, 'system', 'COMMAND' FROM {units} WHERE language = 'python' AND sink = 1 UNION ALL SELECT path, 'system', 'COMMAND' FROM {units} WHERE dead UNION ALL SELECT path, 'eval', 'EVAL' FROM {units} WHERE language = 'python' AND fn % 19 = 0 UNION ALL SELECT path, 'innerHTML', 'DOM' FROM {units} WHERE language = 'javascript' AND sink = 0 UNION ALL SELECT path, 'eval', 'EVAL' FROM {units} WHERE language = 'javascript' AND sink = 1 UNION ALL SELECT path, 'Function', 'EVAL' FROM {units} WHERE language = 'javascript' AND fn % 7 = 0) s GROUP BY path, sink, category",
)
def t_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(source_files(spark, sf_dir)).where("kind = 'sink'")
    return f.groupBy("path", F.col("name").alias("sink"), F.col("detail").alias("category")).agg(F.count("*").alias("n"))


@native("t_04_sanitizer_match", "units", sql="SELECT path, CASE language WHEN 'python' THEN 'int' ELSE 'DOMPurify.sanitize' END AS sanitizer FROM {units} WHERE sanitised AND language <> 'go'")
def t_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(source_files(spark, sf_dir)).where("kind = 'sanitizer'").select("path", F.col("name").alias("sanitizer"))


_STEPS = {
    "t_06_source_assignment": ("origin_kind = 'source' and kind = 'argument'", "SELECT DISTINCT u.path, concat('f', CAST(c.callee AS VARCHAR)) AS target, t.clean FROM {unit_calls} c JOIN {units} u ON u.fn = c.caller JOIN {unit_taint} t ON t.fn = u.fn WHERE u.is_source", " and position = 0 and target rlike '^f[0-9]+$'"),
    "t_09_unknown_call": ("origin_kind = 'param' and kind = 'argument'", "SELECT DISTINCT u.path, concat('f', CAST(c.callee AS VARCHAR)) AS target, t.clean FROM {unit_calls} c JOIN {units} u ON u.fn = c.caller JOIN {unit_taint} t ON t.fn = u.fn WHERE NOT u.is_source", " and position = 0 and target rlike '^f[0-9]+$'"),
}
for _id, (_where, _sql, _more) in _STEPS.items():

    @native(_id, "unit_calls", "units", "unit_taint", sql=_sql)
    def _step(spark: SparkSession, sf_dir: str, where: str = _where + _more) -> DataFrame:
        """What goes into calls of the code base, and what it is safe for after assignments, sanitizers and guards."""
        return flows(source_files(spark, sf_dir)).where(where).select("path", "target", "clean").distinct()


@native("t_10_sink_check", "unit_taint", sql=f"SELECT path, CASE WHEN is_source THEN 'source' ELSE 'param' END AS origin_kind, {CATEGORY.format(bit='sink_bit')} AS category FROM {{unit_taint}} WHERE sink_bit > 0 AND (clean & sink_bit) = 0")
def t_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(source_files(spark, sf_dir)).where("kind = 'hit' and origin_kind <> 'call'").select("path", "origin_kind", "category").distinct()


@native("t_12_intraprocedural_taint", "unit_taint", sql=f"SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, {CATEGORY.format(bit='sink_bit')} AS category FROM {{unit_taint}} WHERE is_source AND sink_bit > 0 AND (clean & sink_bit) = 0")
def t_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(source_files(spark, sf_dir)).where("kind = 'hit' and origin_kind = 'source'").select("path", "function", "category").distinct()


# imports, calls, orphans

_FOLDER = "CASE WHEN CAST(c.callee % 5 AS INT) = u.pkg THEN concat({same}, CAST(c.callee AS VARCHAR)) ELSE concat({other}, CAST(c.callee % 5 AS VARCHAR), {sep}, CAST(c.callee AS VARCHAR)) END"
_PY_IMPORTS = f"""SELECT path, 'os' AS name, 'STDLIB' AS category, NULL AS resolved FROM {{units}} WHERE {_PY} UNION ALL SELECT path, 'flask', 'EXTERNAL', NULL FROM {{units}} WHERE {_PY}
UNION ALL SELECT path, 'hashlib', 'STDLIB', NULL FROM {{units}} WHERE {_PY} AND (fn % 21 = 0 OR fn % 22 = 0) UNION ALL SELECT path, concat('pkg', CAST(pkg AS VARCHAR), '.gone'), 'UNRESOLVED', NULL FROM {{units}} WHERE {_PY} AND fn % 6 = 0
UNION ALL SELECT u.path, {_FOLDER.format(same="'.m'", other="'pkg'", sep="'.m'")}, 'LOCAL', t.path FROM {{unit_calls}} c JOIN {{units}} u ON u.fn = c.caller JOIN {{units}} t ON t.fn = c.callee WHERE u.language = 'python'"""
_JS_IMPORTS = f"""SELECT path, 'react' AS name, 'EXTERNAL' AS category, NULL AS resolved FROM {{units}} WHERE {_JS}
UNION ALL SELECT u.path, {_FOLDER.format(same="'./m'", other="'../pkg'", sep="'/m'")}, 'LOCAL', t.path FROM {{unit_calls}} c JOIN {{units}} u ON u.fn = c.caller JOIN {{units}} t ON t.fn = c.callee WHERE u.language = 'javascript'"""


@native("j_06_import_resolution", "units", "unit_calls", sql=_PY_IMPORTS)
def j_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, f = _imported(spark, sf_dir, "path like '%.py'")
    return python_imports(f, files)


@native("j_07_js_resolution", "units", "unit_calls", sql=_JS_IMPORTS)
def j_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, f = _imported(spark, sf_dir, r"path rlike '\\.(m?jsx?|tsx?)$'")
    return javascript_imports(f, files)


@native("j_08_go_resolution", "units", sql="SELECT path, 'fmt' AS name, 'STDLIB' AS category FROM {units} WHERE language = 'go' UNION ALL SELECT path, concat('example.com/app/pkg', CAST((fn + 1) % 5 AS VARCHAR)), 'LOCAL' FROM {units} WHERE language = 'go' UNION ALL SELECT path, concat('github.com/x/y', CAST(fn % 4 AS VARCHAR)), 'EXTERNAL' FROM {units} WHERE language = 'go'")
def j_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return go_imports(facts(source_files(spark, sf_dir).where("language = 'go'")), "example.com/app")


@native("g_01_import_graph", "units", "unit_calls", sql=f"SELECT path AS importer, coalesce(resolved, name) AS imported, category, count(*) AS n FROM ({_PY_IMPORTS} UNION ALL {_JS_IMPORTS}) i GROUP BY path, coalesce(resolved, name), category")
def g_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files; imports that lead out of the code base stay as rows of their own kind."""
    files, f = _imported(spark, sf_dir, r"path like '%.py' or path rlike '\\.(m?jsx?|tsx?)$'")
    return all_imports(f, files).groupBy(F.col("path").alias("importer"), F.coalesce("resolved", "name").alias("imported"), "category").agg(F.count("*").alias("n"))


_TIERS = f"""SELECT u.path, concat('f', CAST(c.callee AS VARCHAR)) AS callee, 'IMPORTED' AS tier FROM {{unit_calls}} c JOIN {{units}} u ON u.fn = c.caller
UNION ALL SELECT path, concat('_h', CAST(fn AS VARCHAR)), 'SAME_FILE' FROM {{units}} WHERE helps
UNION ALL SELECT path, 'shared', CASE WHEN (SELECT count(*) FROM {{units}} WHERE shares) > 1 THEN 'AMBIGUOUS' ELSE 'UNIQUE' END FROM {{units}} WHERE asks
UNION ALL SELECT path, 'only_here', CASE WHEN fn = 1 THEN 'SAME_FILE' ELSE 'UNIQUE' END FROM {{units}} WHERE asks UNION ALL SELECT path, 'nowhere', 'MISSING_IMPORT' FROM {{units}} WHERE asks
UNION ALL SELECT path, 'Store', 'MISSING_IMPORT' FROM {{units}} WHERE stores UNION ALL SELECT path, 's.save', 'EXTERNAL_MODULE' FROM {{units}} WHERE stores UNION ALL SELECT path, 'ValueError', 'MISSING_IMPORT' FROM {{units}} WHERE validated
UNION ALL SELECT path, 'int', 'MISSING_IMPORT' FROM {{units}} WHERE {_PY} AND sanitised UNION ALL SELECT path, 'x.isdigit', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_PY} AND guarded
UNION ALL SELECT path, 'cursor.execute', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_PY} AND sink = 0 UNION ALL SELECT path, 'os.system', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_PY} AND (sink = 1 OR dead)
UNION ALL SELECT path, 'eval', 'MISSING_IMPORT' FROM {{units}} WHERE {_PY} AND fn % 19 = 0 UNION ALL SELECT path, 'hashlib.md5', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_PY} AND (fn % 21 = 0 OR fn % 22 = 0)
UNION ALL SELECT path, 'DOMPurify.sanitize', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_JS} AND sanitised UNION ALL SELECT path, 'eval', 'MISSING_IMPORT' FROM {{units}} WHERE {_JS} AND sink = 1
UNION ALL SELECT path, 'localStorage.setItem', 'EXTERNAL_MODULE' FROM {{units}} WHERE {_JS} AND sink = 2 UNION ALL SELECT path, 'Function', 'MISSING_IMPORT' FROM {{units}} WHERE {_JS} AND fn % 7 = 0
UNION ALL SELECT path, 'sanitizeHtml', 'MISSING_IMPORT' FROM {{units}} WHERE {_JS} AND fn % 5 = 0 AND sanitised
UNION ALL SELECT path, 'fmt.Println', 'EXTERNAL_MODULE' FROM {{units}} WHERE false"""


@native("j_09_call_resolution", "unit_calls", "units", sql=_TIERS)
def j_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    (resolved,) = _calls_and(spark, sf_dir)
    # the receiver of a regular expression's test has no name
    return resolved.where("callee not like '?%'").select("path", "callee", "tier").distinct()


@native("a_20_resolution_stats", "unit_calls", "units", sql=f"SELECT count(*) AS sites, CAST(sum(CASE WHEN tier = 'SAME_FILE' THEN 1 ELSE 0 END) AS BIGINT) AS local_calls, CAST(sum(CASE WHEN tier = 'IMPORTED' THEN 1 ELSE 0 END) AS BIGINT) AS imported, round(CAST(sum(CASE WHEN tier IN ('SAME_FILE', 'IMPORTED', 'UNIQUE') THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS rate FROM ({_TIERS}) t")
def a_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.count_if(F.col("tier").isin("SAME_FILE", "IMPORTED", "UNIQUE", "METHOD", "MODULE"))
    return j_09(spark, sf_dir).agg(F.count("*").alias("sites"), F.count_if(F.col("tier") == "SAME_FILE").alias("local_calls"), F.count_if(F.col("tier") == "IMPORTED").alias("imported"), F.round(found / F.count("*"), 4).alias("rate"))


_ORPHANS = f"SELECT path, concat('f', CAST(fn AS VARCHAR)) AS name FROM {{units}} WHERE language <> 'go' AND fn NOT IN (SELECT callee FROM {{unit_calls}}) UNION ALL SELECT path, 'shared' FROM {{units}} WHERE shares UNION ALL SELECT path, 'only_here' FROM {{units}} WHERE fn = 1 UNION ALL SELECT path, 'Store' FROM {{units}} WHERE stores UNION ALL SELECT path, 'save' FROM {{units}} WHERE stores UNION ALL SELECT path, concat('T', CAST(fn AS VARCHAR)) FROM {{units}} WHERE language = 'go' UNION ALL SELECT path, concat('F', CAST(fn AS VARCHAR)) FROM {{units}} WHERE language = 'go'"


@native("j_11_orphan_exports", "units", "unit_calls", sql=_ORPHANS)
def j_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f, imports = _resolution(spark, sf_dir)
    return orphan_exports(f, imports)


@native("arc_008_orphan_export", "units", "unit_calls", sql=f"SELECT path, name, 'LOW' AS severity FROM ({_ORPHANS}) o")
def arc_008(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j_11(spark, sf_dir).withColumn("severity", F.lit("LOW"))


# across functions

_ACROSS = f"""WITH RECURSIVE r AS (
 SELECT u.fn AS src, u.path AS source_path, u.fn AS fn, u.clean, 0 AS depth FROM {{unit_taint}} u WHERE u.is_source AND u.clean < 15
 UNION SELECT r.src, r.source_path, t.fn, r.clean | t.clean, r.depth + 1 FROM r JOIN {{unit_calls}} c ON c.caller = r.fn JOIN {{unit_taint}} t ON t.fn = c.callee AND NOT t.is_source WHERE r.depth < {MOST_CALLS} AND (r.clean | t.clean) < 15)
SELECT r.source_path, concat('f', CAST(r.src AS VARCHAR)) AS source_function, t.path AS sink_path, concat('f', CAST(r.fn AS VARCHAR)) AS sink_function, {CATEGORY.format(bit='t.sink_bit')} AS category, CAST(min(r.depth) AS INTEGER) AS depth
FROM r JOIN {{unit_taint}} t ON t.fn = r.fn WHERE r.depth > 0 AND t.sink_bit > 0 AND (r.clean & t.sink_bit) = 0 GROUP BY r.source_path, r.src, t.path, r.fn, t.sink_bit"""


@native("t_14_interprocedural", "unit_taint", "unit_calls", sql=_ACROSS)
def t_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sink that a source reaches through calls."""
    resolved, summary = _links_and(spark, sf_dir, flows=(FLOWS, _flows))
    return interprocedural(spark, summary, resolved)


for _id, _category in (("sec_py_011_sql_interprocedural", "SQL"), ("sec_py_012_command_interprocedural", "COMMAND"), ("sec_js_010_eval_interprocedural", "EVAL")):

    @native(_id, "unit_taint", "unit_calls", sql=f"SELECT sink_path, sink_function, count(*) AS paths FROM ({_ACROSS}) a WHERE category = '{_category}' GROUP BY sink_path, sink_function")
    def _across(spark: SparkSession, sf_dir: str, category: str = _category) -> DataFrame:
        """Findings at the sink's file, with the sources that reach it."""
        resolved, summary = _links_and(spark, sf_dir, flows=(FLOWS, _flows))
        return sources_by_sink(spark, summary, resolved, category)


# control flow

_IFS = f"{_B('guarded')} + 2 * {_B('dead')} + {_B('validated')}"


@native("c_01_cfg", "units", sql=f"SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, CAST(2 + 2 * ({_IFS}) AS INTEGER) AS blocks, CAST(1 + 3 * ({_IFS}) AS INTEGER) AS edges FROM {{units}} WHERE language <> 'go'")
def c_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), GRAPHS, _graphs).where(r"function rlike '^f[0-9]+$'").select("path", "function", "blocks", "edges")


@native("c_01_edge_kinds", "units", sql=f"SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'TRUE_BRANCH' AS kind, {_IFS} AS n FROM {{units}} WHERE language <> 'go' UNION ALL SELECT 'FALSE_BRANCH', {_IFS} FROM {{units}} WHERE language <> 'go' UNION ALL SELECT 'EARLY_EXIT', 1 + {_B('guarded')} + {_B('dead')} + {_B('validated')} FROM {{units}} WHERE language <> 'go' UNION ALL SELECT 'UNCONDITIONAL', {_B('dead')} FROM {{units}} WHERE language <> 'go') k GROUP BY kind")
def c_01_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), EDGES, _edges).where(r"function rlike '^f[0-9]+$'").groupBy("kind").agg(F.count("*").alias("n"))


@native("c_02_guards", "units", sql=f"SELECT path, op, fact, count(*) AS n FROM (SELECT path, 'IS_NONE' AS op, 'not_none' AS fact FROM {{units}} WHERE validated OR dead UNION ALL SELECT path, 'IS_NONE', 'not_none' FROM {{units}} WHERE dead UNION ALL SELECT path, 'IS_DIGIT', 'numeric' FROM {{units}} WHERE {_PY} AND guarded UNION ALL SELECT path, 'REGEX', 'not_none+numeric' FROM {{units}} WHERE {_JS} AND guarded UNION ALL SELECT path, 'TRUTHY', 'not_none' FROM {{units}} WHERE helps) g GROUP BY path, op, fact")
def c_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), GUARDS, _guards).groupBy("path", "op", "fact").agg(F.count("*").alias("n"))


@native("c_03_paths", "units", sql=f"SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, CAST(1 + {_B('dead')} + {_B('guarded')} + {_B('validated')} AS INTEGER) AS paths, CAST({_B('dead')} AS INTEGER) AS infeasible FROM {{units}} WHERE language <> 'go'")
def c_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), GRAPHS, _graphs).where(r"function rlike '^f[0-9]+$'").select("path", "function", "paths", "infeasible")


@native("f_15_path_infeasibility", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function FROM {units} WHERE dead")
def f_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), GRAPHS, _graphs).where("infeasible > 0").select("path", "function")


# objects, scopes, constants, contracts


@native("t_16_constant_branches", "units", sql="SELECT path, concat('_h', CAST(fn AS VARCHAR)) AS callee, 'TRUE_BRANCH' AS branch FROM {units} WHERE helps")
def t_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant that goes into a parameter which a condition tests selects the branch."""
    # without one of these words a text has no such constant
    files = source_files(spark, sf_dir).where("content rlike '(?i)true|false'")
    given, params, tested = together(
        files,
        "constants",
        parse_choices,
        given=(FLOWS, _choices),
        params=(FACTS, lambda path, m: _facts(path, Module(m.language, functions=[replace(f, body=[], decorators=[]) for f in m.functions]))),
        tested=(GUARDS, lambda path, m: (r for r in _guards(path, m) if r[2] == "TRUTHY")),
    )
    given = given.select("path", F.col("target").alias("callee"), "position", "origin")
    params = params.select(F.col("path").alias("p"), F.col("name").alias("f"), F.posexplode(F.split("detail", ",")).alias("i", "param"))
    tested = tested.select(F.col("path").alias("q"), F.col("function").alias("g"), "variable").distinct()
    met = given.join(params, (F.col("path") == F.col("p")) & (F.col("callee") == F.col("f")) & (F.col("position") == F.col("i")))
    met = met.join(tested, (F.col("p") == F.col("q")) & (F.col("f") == F.col("g")) & (F.col("param") == F.col("variable")))
    return met.select("path", "callee", F.when(F.col("origin") == "True", "TRUE_BRANCH").otherwise("FALSE_BRANCH").alias("branch"))


def _objects(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return mapped(source_files(spark, sf_dir), OBJECTS, lambda path, m: iter(objects.facts(m))).where(F.col("kind") == kind).select("path", "function", "name", "detail")


@native("t_17_aliases", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, 't' AS name, 's' AS detail FROM {units} WHERE stores UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'x', 'a' FROM {units} WHERE language <> 'go' AND NOT is_source")
def t_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir, "alias")


@native("t_18_field_updates", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, 't.value' AS name, 'STRONG' AS detail FROM {units} WHERE stores UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'el.innerHTML', 'STRONG' FROM {units} WHERE language = 'javascript' AND sink = 0")
def t_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir, "field")


@native("t_19_types", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, n AS name, 'Store' AS detail FROM {units}, (VALUES ('s'), ('t')) v(n) WHERE stores UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'x', 'int' FROM {units} WHERE language = 'python' AND sanitised UNION ALL SELECT path, concat('T', CAST(fn AS VARCHAR), '.F', CAST(fn AS VARCHAR)), n, 'int' FROM {units}, (VALUES ('a'), ('b')) v(n) WHERE language = 'go' UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'n', k FROM {units}, (VALUES ('int'), ('str')) v(k) WHERE language = 'python' AND fn % 29 = 0")
def t_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir, "type")


@native("t_22_def_use", "units", sql="SELECT path, 's' AS name, CAST(2 AS BIGINT) AS uses FROM {units} WHERE stores UNION ALL SELECT path, 'flag', CAST(1 AS BIGINT) FROM {units} WHERE helps")
def t_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = mapped(source_files(spark, sf_dir), USES, lambda path, m: iter(objects.definitions(m)))
    return uses.where("name in ('s', 'flag')").groupBy("path", "name").agg(F.count("*").alias("uses"))


_NEEDS = f"SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, 'requires' AS kind, '0' AS name, {CATEGORY.format(bit='sink_bit')} AS detail FROM {{unit_taint}} WHERE NOT is_source AND sink_bit > 0 AND (clean & sink_bit) = 0"


@native("c_06_contracts", "unit_taint", "units", sql=f"{_NEEDS} UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'raises', 'ValueError', 'a is None' FROM {{units}} WHERE validated UNION ALL SELECT path, concat('f', CAST(fn AS VARCHAR)), 'ensures', '0', 'not_none' FROM {{units}} WHERE validated")
def c_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped(source_files(spark, sf_dir), OBJECTS, lambda path, m: iter(contracts.contracts(m)))
    return rows.where("kind in ('requires', 'raises', 'ensures')").select("path", "function", "kind", "name", "detail")


_VERIFIED = f"""SELECT a.path, concat('f', CAST(a.fn AS VARCHAR)) AS function, b.path AS callee_path, concat('f', CAST(b.fn AS VARCHAR)) AS callee, {CATEGORY.format(bit='b.sink_bit')} AS category,
 CASE WHEN (a.clean & b.sink_bit) > 0 THEN 'SATISFIED' WHEN a.is_source THEN 'VIOLATED' ELSE 'UNKNOWN' END AS state
FROM {{unit_calls}} c JOIN {{unit_taint}} a ON a.fn = c.caller JOIN {{unit_taint}} b ON b.fn = c.callee WHERE NOT b.is_source AND b.sink_bit > 0 AND (b.clean & b.sink_bit) = 0"""


@native("c_07_precondition", "unit_calls", "unit_taint", sql=_VERIFIED)
def c_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, summary = _links_and(spark, sf_dir, flows=(FLOWS, lambda path, m: (r for r in _flows(path, m) if r[1] in ("hit", "argument"))))
    return preconditions(summary, resolved)


@native("c_09_composition", "unit_calls", "unit_taint", sql=f"SELECT path, function, CASE WHEN max(CASE WHEN state = 'VIOLATED' THEN 1 ELSE 0 END) = 1 THEN 'VIOLATED' WHEN max(CASE WHEN state = 'UNKNOWN' THEN 1 ELSE 0 END) = 1 THEN 'UNKNOWN' ELSE 'SATISFIED' END AS overall FROM ({_VERIFIED}) v GROUP BY path, function")
def c_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.min(F.when(F.col("state") == "VIOLATED", 0).when(F.col("state") == "UNKNOWN", 1).otherwise(2))
    return c_07(spark, sf_dir).groupBy("path", "function").agg(F.element_at(F.array(F.lit("VIOLATED"), F.lit("UNKNOWN"), F.lit("SATISFIED")), worst + 1).alias("overall"))


@native("c_11_contract_pruning", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, fn % 6 <> 1 AS skip_callers FROM {units} WHERE language <> 'go' AND fn % 3 = 1")
def c_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of a function whose contract's hash is the same as before need no new look; here a changed file raises on empty input."""
    files = source_files(spark, sf_dir)
    number = F.regexp_extract("path", r"m(\d+)\.", 1).cast("long")
    added = F.when(F.col("language") == "python", F.regexp_replace("content", r"(?m)^(def f\d+\(a, cursor\):)$", "$1\n    if a == 0:\n        raise KeyError(a)")).otherwise(F.regexp_replace("content", r"(?m)^(export function f\d+\(a, el\) \{)$", "$1\n  if (a === 0) { throw new Error(a) }"))
    moved = F.concat(F.lit("\n\n"), "content")  # lines move, the contract stays
    after = files.withColumn("content", F.when(number % 6 == 1, added).otherwise(moved))
    hashes = lambda x, name: mapped(x, OBJECTS, lambda path, m: iter(contracts.contracts(m))).where(r"kind = 'hash' and function rlike '^f[0-9]+$'").select("path", "function", F.col("name").alias(name))
    some = (number % 3 == 1) & (F.col("language") != "go")
    return hashes(files.where(some), "old").join(hashes(after.where(some), "new"), ["path", "function"]).select("path", "function", (F.col("old") == F.col("new")).alias("skip_callers"))


# what contracts and types say at call sites


@native("c_08_postcondition_binding", "unit_calls", "units", sql="SELECT a.path, concat('f', CAST(c.callee AS VARCHAR)) AS callee, 'ARGUMENT' AS bound, 'not_none' AS fact FROM {unit_calls} c JOIN {units} a ON a.fn = c.caller JOIN {units} b ON b.fn = c.callee WHERE b.validated")
def c_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a call returns, what its contract ensures of a parameter holds of the argument."""
    resolved, ensured, summary = _links_and(spark, sf_dir, ensured=(OBJECTS, lambda path, m: iter(contracts.ensured(m))), flows=(FLOWS, lambda path, m: (r for r in _flows(path, m) if r[1] == "argument")))
    ensured = ensured.select(F.col("path").alias("to_path"), F.col("function").alias("to"), F.col("name").cast("int").alias("i"), F.col("detail").alias("fact"))
    targets = _targets(resolved).withColumnsRenamed({"target_path": "to_path", "target": "to"})
    given = summary.select(F.col("path").alias("p"), F.col("target").alias("c"), F.col("position").alias("j")).distinct()
    met = targets.join(ensured, ["to_path", "to"]).join(given, (F.col("path") == F.col("p")) & (F.col("callee") == F.col("c")) & (F.col("i") == F.col("j")))
    return met.select("path", "callee", F.lit("ARGUMENT").alias("bound"), "fact").distinct()


@native("a_29_contract_conflicts", "units", sql="SELECT path, concat('f', CAST(fn AS VARCHAR)) AS function, 'n' AS name FROM {units} WHERE language = 'python' AND fn % 29 = 0")
def a_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that are claimed to be a number and a text."""
    types = mapped(source_files(spark, sf_dir), OBJECTS, lambda path, m: iter(objects.facts(m))).where("kind = 'type'")
    return types.groupBy("path", "function", "name").agg(F.collect_set("detail").alias("t")).where("array_contains(t, 'int') and array_contains(t, 'str')").select("path", "function", "name")


@native("j_10_typed_dispatch", "units", sql="SELECT path, 's.save' AS callee, 'Store.save' AS target FROM {units} WHERE stores")
def j_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method calls whose receiver has one type, to that type's method."""
    files = source_files(spark, sf_dir)
    receivers = mapped(files, OBJECTS, lambda path, m: iter(objects.facts(m))).where("kind = 'receiver'").groupBy("path", F.col("name").alias("callee")).agg(F.min("detail").alias("type"), F.countDistinct("detail").alias("n")).where("n = 1")
    methods = facts(files).where("kind = 'function'").select(F.col("path").alias("p"), F.col("name").alias("target"))
    last = F.element_at(F.split("callee", r"\."), -1)
    return receivers.join(methods, (F.col("path") == F.col("p")) & (F.concat_ws(".", "type", last) == F.col("target"))).select("path", "callee", "target")


STATES = "path string, function string, name string, state string"
_STATE = "CASE WHEN NOT is_source THEN 'UNTAINTED' WHEN clean > 0 THEN 'SANITIZED' ELSE 'TAINTED' END"
_RANKED = f"SELECT regexp_extract(path, '^src/([^/]+)/', 1) AS package, {_STATE} AS state FROM {{unit_taint}}"


def _states(path: str, m: Module) -> Iterator[tuple]:
    for s in flow.summaries(m):
        for name, state in s.states.items():
            yield s.function, name, state


def _by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped(source_files(spark, sf_dir), STATES, _states).where(r"name = 'x' and function rlike '^f[0-9]+$'")
    return rows.select(F.regexp_extract("path", "^src/([^/]+)/", 1).alias("package"), "state")


@native("t_01_taint_join", "unit_taint", sql=f"SELECT package, CASE max(CASE state WHEN 'TAINTED' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'SANITIZED' THEN 1 ELSE 0 END) WHEN 3 THEN 'TAINTED' WHEN 2 THEN 'UNKNOWN' WHEN 1 THEN 'SANITIZED' ELSE 'UNTAINTED' END AS state FROM ({_RANKED}) r GROUP BY package")
def t_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of a package's values: the state that stands highest."""
    place = F.array_position(F.array(*map(F.lit, flow.STATES)), F.col("state"))
    return _by_package(spark, sf_dir).groupBy("package").agg(F.max_by("state", place).alias("state"))


@native("c_04_state_join", "unit_taint", sql=f"SELECT package, CASE WHEN max(CASE WHEN state = 'TAINTED' THEN 1 ELSE 0 END) = 1 THEN 'TAINTED' WHEN min(CASE WHEN state = 'SANITIZED' THEN 1 ELSE 0 END) = 1 THEN 'SANITIZED' ELSE 'UNTAINTED' END AS state FROM ({_RANKED}) r GROUP BY package")
def c_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where paths meet: sanitized only if it is so on all of them. Other than the taint join."""
    state = F.when(F.max(F.col("state") == "TAINTED"), "TAINTED").when(F.min(F.col("state") == "SANITIZED"), "SANITIZED").otherwise("UNTAINTED")
    return _by_package(spark, sf_dir).groupBy("package").agg(state.alias("state"))


def frameworks(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(framework, evidence, confidence): kinds of evidence in the sources (path, content) and the manifests (name, content), each counted once."""
    text = manifests.select(F.lower("content").alias("content"), "name")
    seen = lambda df, cond, framework, what: df.where(cond).limit(1).select(F.lit(framework).alias("framework"), F.lit(what).alias("what"))
    c, p = F.col("content"), F.col("path")
    arms = [
        seen(text, F.col("name").rlike("(^|/)manage.py$"), "django", "manage.py"), seen(files, p.contains("settings.py"), "django", "settings"), seen(text, c.contains("django"), "django", "declared"), seen(files, c.rlike("(?m)^(from|import) django"), "django", "imported"),
        seen(text, c.contains("flask"), "flask", "declared"), seen(files, c.contains("from flask import") | c.rlike("(?m)^import flask"), "flask", "imported"),
        seen(text, c.contains('"react"'), "react", "declared"), seen(text, c.contains('"react-dom"'), "react", "dom declared"), seen(files, p.rlike(r"\.[jt]sx$"), "react", "components"), seen(files, c.rlike("""from ['"]react['"]|import React"""), "react", "imported"),
        seen(text, c.contains('"express"'), "express", "declared"), seen(text, c.contains("express"), "express", "in a manifest"), seen(files, c.rlike("""require\\(['"]express['"]\\)|from ['"]express['"]"""), "express", "imported"),
    ]
    every = arms[0]
    for a in arms[1:]:
        every = every.union(a)
    n, base = F.count("*"), F.when(F.col("framework") == "flask", 0.45).otherwise(0.40)
    step, most = F.when(F.col("framework").isin("flask", "express"), 0.25).otherwise(0.20), F.when(F.col("framework") == "flask", 0.95).otherwise(0.98)
    found = every.groupBy("framework").agg(n.alias("evidence"))
    return found.select("framework", "evidence", F.round(F.least(most, base + step * F.col("evidence")), 2).alias("confidence"))


@native("s_09_frameworks", "units", sql="SELECT * FROM (VALUES ('flask', CAST(2 AS BIGINT), 0.95::DOUBLE), ('react', CAST(2 AS BIGINT), 0.80::DOUBLE)) v(framework, evidence, confidence)")
def s_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = spark.createDataFrame([("requirements.txt", "Flask==3.0\n"), ("package.json", '{"dependencies": {"react": "18"}}')], "name string, content string")
    return frameworks(source_files(spark, sf_dir), manifests)
