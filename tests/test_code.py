"""Readers, flow, control flow, objects, contracts and rules on hand-made sources; no Spark."""

import math

import pytest

from girder.code import cfg, contracts, flow, go, guards, javascript, objects, python, rules
from girder.code.ir import show, statements
from girder.operators import source_code


def hits(source, language="python"):
    m = python.read(source) if language == "python" else javascript.read(source, language)
    assert not m.errors, m.errors
    return sorted((h.category, h.line) for _, h in flow.findings(m))


def found(source, language="python"):
    m = python.read(source) if language == "python" else javascript.read(source, language)
    return sorted({r[0] for r in rules.findings(m)})


# readers


def test_python_reader():
    m = python.read("import a.b as c, os\nfrom . import x\nfrom ..y import z as w\nclass K(Base):\n    n = 1\n    def go(self, a, *, b=2):\n        def _inner():\n            return a\n        return _inner\nasync def f(q: int) -> str:\n    async with q as r:\n        pass\nmod = __import__('lazy')\n")
    assert [(i.module, i.names, i.level, i.kind) for i in m.imports] == [("a.b", (("a.b", "c"),), 0, "static"), ("os", (("os", "os"),), 0, "static"), ("", (("x", "x"),), 1, "from"), ("y", (("z", "w"),), 2, "from"), ("lazy", (), 0, "dynamic")]
    assert [(f.qualified, [p.name for p in f.params], f.owner) for f in m.functions] == [("K.go", ["self", "a", "b"], "K"), ("K.go._inner", [], ""), ("f", ["q"], "")]
    assert m.classes[0].name == "K" and m.classes[0].fields == ("n",) and [e[0] for e in m.exports] == ["go", "K", "f"]
    assert python.read("def broken(:\n").errors == [("SyntaxError", 1)] and python.read("").functions == []


JS = r"""
import React, { useState as us, type FC } from 'react';
import * as path from "path"
const fs = require('fs'), { join, resolve: rs } = require("path");
export const API = `https://x/${process.env.HOST}/v1`;
export default function App({ items, title = "x" }: Props): JSX.Element {
  const [a, setA] = us<number>(0);
  const re = /ab+c"'/g.test(title) ? 1 : 2;
  if (!items || items.length > 3 && a >= 2) { return null }
  for (let i = 0; i < items.length; i++) { go(items[i]); }
  items.map(async (x) => { await go(x); });
  return <div className="a" onClick={() => setA(a + 1)}>{title} it's "text" <b>bold</b><Foo {...items} /></div>;
}
export class Svc extends Base implements I {
  private x: number = 1;
  static async run(req, res) { try { await go(req) } catch (e) { throw new Error("x") } finally { done() } }
  get y() { return this.x as any; }
}
const add = (a: number, b = 2): number => a + b;
export { add as plus };
export * from './more';
interface Foo { a: string; b(): void }
type T = { a: string } | null;
switch (x) { case 1: f(1); break; default: g() }
const o = { a, b: 1, c() { return 2 }, ['d']: 3, ...rest };
const l = import('./lazy');
var w = a < b && c > d;
"""


def test_javascript_reader():
    m = javascript.read(JS, "typescript")
    assert not m.errors
    assert [(i.module, i.kind) for i in m.imports] == [("react", "static"), ("path", "static"), ("fs", "require"), ("path", "require"), ("./more", "export"), ("./lazy", "dynamic")]
    assert m.imports[0].names == (("default", "React"), ("useState", "us"), ("FC", "FC")) and m.imports[3].names == (("join", "join"), ("resolve", "rs"))
    names = [f.qualified for f in m.functions]
    assert {"App", "Svc.run", "Svc.y", "add", "c"} <= set(names) and [e[0] for e in m.exports] == ["API", "App", "Svc", "plus"]
    assert [(n, show(v)) for n, v, _ in m.attributes] == [("className", "'a'"), ("onClick", "<function>")]
    app = next(f for f in m.functions if f.name == "App")
    assert [s.kind for s in statements(app.body)].count("assign") >= 5 and app.line == 6


def test_javascript_reader_goes_on_after_what_it_cannot_read():
    m = javascript.read("const a = ;\nfunction ok(x) { return x }\nlet b = (1 + ;\nfunction two() {}\n")
    assert m.errors and {"ok", "two"} <= {f.name for f in m.functions}
    for odd in ("", "`${", "/*", "'", "<div>", "}}}}", "class {", "import", "export", "a ? b", "=> =>", "\u2028", "({" * 50):
        javascript.read(odd)


def test_go_reader():
    m = go.read('package main\nimport "fmt"\nimport (\n  x "a/b"\n  . "c.com/d"\n)\ntype Server struct {\n  Name string\n  port int\n}\nfunc (s *Server) Run(a, b int, c map[string]func(int) bool) (int, error) { if true { return 1 } }\nfunc main() { fmt.Println("func x(") }\nfunc Gen[T any](x T) T { return x }\n')
    assert [i.module for i in m.imports] == ["fmt", "a/b", "c.com/d"] and m.imports[1].names == (("a/b", "x"),)
    assert [(f.qualified, [(p.name, p.annotation) for p in f.params]) for f in m.functions] == [("Server.Run", [("a", "int"), ("b", "int"), ("c", "map[string]func(int)bool")]), ("main", []), ("Gen", [("x", "T")])]
    assert m.classes[0].fields == ("Name", "port") and [e[0] for e in m.exports] == ["Server", "Run", "Gen"]


# flow


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("q = request.args['x']\n  cursor.execute(q)", [("SQL", 3)]),
        ("q = request.args.get('x')\n  cursor.execute('a' + q)", [("SQL", 3)]),
        ("q = request.get_json()\n  os.system(f'ls {q}')", [("COMMAND", 3)]),
        ("q = int(request.args['x'])\n  cursor.execute(q)", []),
        ("q = shlex.quote(request.args['x'])\n  os.system(q)\n  cursor.execute(q)", [("SQL", 4)]),
        ("q = request.form['x']\n  q = 'safe'\n  cursor.execute(q)", []),
        ("q = request.form['x']\n  cursor.execute('select %s', q)", []),
        ("q = 'a'\n  if q:\n    q = request.form['x']\n    return\n  cursor.execute(q)", []),
        ("q = 'a'\n  if q:\n    q = request.form['x']\n  cursor.execute('s' + q)", [("SQL", 5)]),
        ("q = request.form['x']\n  if z:\n    q = int(q)\n  cursor.execute(q)", [("SQL", 5)]),
        ("q = request.form['x']\n  if not q.isdigit():\n    return\n  cursor.execute(q)", []),
        ("q = request.form['x']\n  if isinstance(q, int) and z:\n    cursor.execute(q)", []),
        ("q = request.form['x']\n  if isinstance(q, int) or z:\n    cursor.execute(q)", [("SQL", 4)]),
        ("q = request.form['x']\n  if q.isalnum():\n    os.system(q)\n    cursor.execute(q)", [("SQL", 5)]),
        ("q = ''\n  for i in x:\n    cursor.execute(q)\n    q = q + request.args['x']", [("SQL", 4)]),
        ("q = unknown(request.args['x'])\n  cursor.execute(q)", [("SQL", 3)]),
        ("try:\n    q = request.args['x']\n  except KeyError:\n    q = ''\n  cursor.execute(q)", [("SQL", 6)]),
        ("try:\n    q = 1\n  finally:\n    q = request.args['x']\n  cursor.execute(q)", [("SQL", 6)]),
        ("a, b = request.args['x'], 1\n  cursor.execute(b)", [("SQL", 3)]),
        ("d = {}\n  d['k'] = request.args['x']\n  cursor.execute(d['k'])", [("SQL", 4)]),
    ],
)
def test_python_flow(body, want):
    assert hits(f"def f(cursor, request, x, z):\n  {body}\n") == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("el.innerHTML = location.search", [("DOM", 1)]),
        ("const q = req.query.q; document.write('<b>' + q)", [("DOM", 1)]),
        ("const { q } = req.body; eval(q)", [("EVAL", 1)]),
        ("const q = DOMPurify.sanitize(location.hash); el.innerHTML = q; eval(q)", [("EVAL", 1)]),
        ("const q = parseInt(req.params.n, 10); eval(q); el.innerHTML = q", []),
        ("const q = req.query.q; if (typeof q === 'number') { eval(q) }", []),
        ("const q = req.query.q; if (!/^\\d+$/.test(q)) return; eval(q)", []),
        ("const q = req.query.q; if (/\\d+/.test(q)) { eval(q) }", [("EVAL", 1)]),
        ("let q = ''; try { q = document.cookie } catch (e) { q = '' } el.outerHTML = `x${q}`", [("DOM", 1)]),
    ],
)
def test_javascript_flow(body, want):
    assert hits(f"function f(req, el) {{ {body} }}", "javascript") == want


def test_summaries_name_parameters_calls_and_returns():
    s = flow.summaries(python.read("def f(a, b, cursor):\n    c = g(a)\n    cursor.execute(b)\n    h(int(a), True)\n    return c\n"))[0]
    assert [(h.origin, h.category) for h in s.hits] == [("param:1", "SQL")] and set(s.returns) == {"param:0", "call:g@2"}
    assert ("g", 2, 0, "param:0", frozenset()) in s.arguments and ("h", 4, 1, "True") in s.constants
    assert next(a for a in s.arguments if a[0] == "h")[4] == frozenset(("SQL", "COMMAND", "DOM", "EVAL"))


def test_lattice():
    way = flow.Way
    assert flow.state({}) == "UNTAINTED" and flow.state({"source:a": way()}) == "TAINTED" and flow.state({"source:a": way(frozenset(("SQL",)))}) == "SANITIZED"
    both = flow.join({"source:a": way(frozenset(("SQL", "DOM")))}, {"source:a": way(frozenset(("DOM",)))})
    assert both["source:a"].clean == {"DOM"} and cfg.join_states({"x": "SANITIZED"}, {"x": "UNTAINTED"}) == {"x": "UNTAINTED"}


# guards and control flow


def test_guards():
    test = lambda text: python.read(f"if {text}:\n    pass\n").body[0].value
    ops = lambda text, expected=True: [(c.variable, c.op, c.expected, c.literal) for c in guards.conditions(test(text), expected)[0]]
    facts = lambda text, expected=True: [(f.variable, f.kind, f.value) for f in guards.conditions(test(text), expected)[1]]
    assert ops("isinstance(x, (int, str))") == [("x", "IS_INSTANCE", True, "int|str")] and facts("isinstance(x, int)") == [("x", "type", "int")]
    assert ops("x is None") == [("x", "IS_NONE", True, "")] and ops("x is None", False) == [("x", "IS_NOT_NONE", True, "")]
    assert ops("not a and b.isdigit()") == [("a", "TRUTHY", False, ""), ("b", "IS_DIGIT", True, "")] and ops("a or b") == [] and len(ops("a or b", False)) == 2
    assert facts(r"re.match(r'^\d+$', x)") == [("x", "not_none", ""), ("x", "numeric", "")] and facts(r"re.match(r'\d+', x)") == []
    assert facts("is_safe_int(x)") == [("x", "numeric", "")] and ops("x == 'a'") == [("x", "EQUALS", True, "'a'")]
    c = guards.Condition
    assert guards.infeasible([c("x", "IS_NONE", True), c("x", "IS_NOT_NONE", True)]) and guards.infeasible([c("x", "TRUTHY", True), c("x", "TRUTHY", False)])
    assert guards.infeasible([c("x", "IS_INSTANCE", True, "int"), c("x", "IS_INSTANCE", True, "str")]) and not guards.infeasible([c("x", "IS_INSTANCE", True, "int"), c("x", "IS_INSTANCE", True, "float")])
    assert guards.infeasible([c("x", "EQUALS", True, "1"), c("x", "EQUALS", True, "2")]) and not guards.infeasible([c("x", "IS_NONE", True), c("y", "IS_NOT_NONE", True)])


def explored(source):
    g = cfg.build(python.read(source).functions[0])
    return g, cfg.explore(g)


def test_graphs_and_paths():
    g, x = explored("def f(a):\n    b = 1\n    return b\n")
    assert [e.kind for e in g.edges] == ["EARLY_EXIT"] and len(x.paths) == 1
    g, x = explored("def f(a):\n    if a is None:\n        return 1\n    if a is None:\n        return 2\n    return 3\n")
    assert len(x.paths) == 2 and x.infeasible == 1
    g, x = explored("def f(a):\n    if a is None:\n        a = 1\n    if a is None:\n        return 2\n    return 3\n")
    assert x.infeasible == 1 and len(x.paths) == 3  # the reassigned a may be None again
    g, x = explored("def f(a):\n    for i in a:\n        if i:\n            break\n        continue\n    while a:\n        a = a - 1\n    return a\n")
    assert {"LOOP_BACK", "LOOP_EXIT"} <= {e.kind for e in g.edges} and x.paths and all(p.blocks[-1] == g.exit for p in x.paths)
    g, x = explored("def f(a):\n    try:\n        g(a)\n    except E:\n        h()\n    finally:\n        k()\n    return 1\n")
    assert {"EXCEPTIONAL", "FINALLY_ENTRY", "FINALLY_EXIT"} <= {e.kind for e in g.edges}
    g, x = explored("def f(a):\n" + "".join(f"    if a{i}:\n        g({i})\n" for i in range(10)))
    assert x.widened > 0 and any(p.status == "WIDENED" for p in x.paths)
    g, x = explored("def f(a):\n" + "".join(f"    if a{i}:\n        return {i}\n" for i in range(10)))
    assert x.truncated == 2 and len(x.paths) == cfg.MOST_BRANCHES + 1
    g, _ = explored("def f(a):\n" + "".join(f"    if a{i}:\n        g({i})\n" for i in range(60)))
    assert g.truncated and len(g.blocks) == cfg.MOST_BLOCKS


# objects, scopes, contracts


def test_objects():
    rows = objects.facts(python.read("class Store:\n    pass\ndef f(p, q: int):\n    a = Store()\n    b = a\n    b.k = p\n    if q:\n        c = a\n    else:\n        c = Store()\n    c.k = q\n    c = b\n    c.go()\n"))
    assert ("f", "points_to", "a", "Store@4", 4) in rows and ("f", "alias", "b", "a", 5) in rows and ("f", "field", "b.k", "STRONG", 6) in rows
    assert ("f", "field", "c.k", "WEAK", 11) in rows and ("f", "type", "q", "int", 3) in rows and ("f", "receiver", "c.go", "Store", 13) in rows
    p = objects.Points
    assert (p(("a", "b")) | p(("c", "d", "e"))).truncated and (p(("a", "b")) | p(("c", "d", "e"))).objects == ("a", "b", "c", "d") and p(("a",)).one and not (p(("a",)) | objects.ANY).one
    w = objects.World()
    for i in range(20):
        w.write(p(("o",)), f"f{i}", p(("x",)))
    assert len(w.fields) == objects.MOST_FIELDS and w.read(p(("o",)), "f19").unknown


def test_definitions():
    rows = objects.definitions(python.read("import os\nx = 1\ndef f(a):\n    y = x\n    y = a\n    def g():\n        return os.path(y)\n    return y\n"))
    assert ("f", "x", 4, 2, "") in rows and ("f", "y", 8, 5, "f") in rows and ("f.g", "y", 7, 4, "f") in rows and ("f.g", "os", 7, 1, "") in rows


def test_contracts():
    rows = contracts.contracts(python.read("def f(x, y, cursor):\n    if x is None:\n        raise ValueError('x')\n    if not isinstance(y, int):\n        raise TypeError\n    cursor.execute(x)\n    return {'a': x}\ndef g(a):\n    return a\n"))
    of = lambda fn, kind: [(r[2], r[3]) for r in rows if r[0] == fn and r[1] == kind]
    assert of("f", "requires") == [("0", "SQL")] and of("f", "raises") == [("ValueError", "x is None"), ("TypeError", "not isinstance(y, int)")]
    assert of("f", "ensures") == [("0", "not_none"), ("1", "type:int")] and of("f", "returns") == [("CONTAINER", "a")] and of("f", "pure") == [("false", "")]
    assert of("g", "returns") == [("PARAMETER", "0")] and of("g", "pure") == [("true", "")] and of("g", "effect") == [("0", "TAINT")]
    h = lambda text: [r[2] for r in contracts.contracts(python.read(text)) if r[1] == "hash"]
    assert h("def f(a):\n    return a\n") == h("\n\n# moved\ndef f(a):\n    b = 1\n    return a\n") != h("def f(a):\n    return 1\n")


# rules


def test_secrets():
    assert rules.entropy("") == 0 and rules.entropy("aaaa") == 0 and math.isclose(rules.entropy("abcd"), 2.0)
    assert rules.likely_secret("sk_live_x") and rules.likely_secret("a8Fk29dLq0ZxW7Tn") and not rules.likely_secret("changeme") and not rules.likely_secret("${SECRET}") and not rules.likely_secret("short")
    assert rules.redacted("abcdef") == "***" and rules.redacted("abcdefgh") == "abc...gh"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("SECRET_KEY = 'a8Fk29dLq0ZxW7TnPq'", ["SEC-PY-001"]),
        ("SECRET_KEY = os.environ['K']\nAPI_KEY = ''\nPASSWORD = 'changeme'", []),
        ("DEBUG = True\napp.run(debug=True)", ["SEC-PY-002"]),
        ("DEBUG = False", []),
        ("subprocess.run(cmd, shell=True)", ["SEC-PY-003"]),
        ("subprocess.run('ls', shell=True)\nsubprocess.run(['ls', '-l'])\nos.system('ls')", []),
        ("eval(x)", ["SEC-PY-004"]),
        ("cursor.execute(f'SELECT * FROM t WHERE a = {x}')", ["SEC-PY-005"]),
        ("cursor.execute('SELECT 1')\ncursor.execute('SELECT %s', (x,))\nlog.execute('a' + b)", []),
        ("hashlib.md5(x)", ["SEC-PY-006"]),
        ("hashlib.md5(x, usedforsecurity=False)\nhashlib.sha256(x)", []),
        ("CORS_ALLOW_ALL_ORIGINS = True", ["SEC-PY-007"]),
        ("CORS(app, origins='*', supports_credentials=True)", ["SEC-PY-007"]),
        ("@csrf_exempt\ndef v(r):\n    pass", ["SEC-PY-008"]),
        ("def v(request):\n    os.system(request.args['c'])", ["SEC-PY-003", "SEC-PY-010"]),
    ],
)
def test_python_rules(source, want):
    assert found(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("eval(x); window.eval(y); track(z)", ["SEC-JS-001"]),
        ("const f = new Function('a', b)", ["SEC-JS-002"]),
        ("const A = () => <div dangerouslySetInnerHTML={{ __html: x }} />", ["SEC-JS-003"]),
        ("const c = DOMPurify.sanitize(x); const A = () => <div dangerouslySetInnerHTML={{ __html: c }} />; const B = () => <p dangerouslySetInnerHTML={{ __html: sanitizeHtml(x) }} />", []),
        ('const clientSecret = "custom_mock_secret_token_1234567890_abcdef";', ["SEC-JS-004"]),
        ('const stripeKey = import.meta.env.KEY; const apiUrl = process.env.URL; const label = "api_key_label"; const publicKey = "pk_live_public_safe";', []),
        ('const L = () => <div><a href="javascript:alert(1)">a</a><a href={`javascript:${p}`}>b</a></div>', ["SEC-JS-005"]),
        ('const L = () => <a href={url}>a</a>; const M = () => <a href="https://x">b</a>', []),
        ("localStorage.setItem('access_token', t)", ["SEC-JS-006"]),
        ("localStorage.setItem('theme', t); store.setItem('token', t)", []),
        ("function f() { el.innerHTML = location.hash }", ["SEC-JS-007"]),
        ("function f(req) { eval(req.query.q) }", ["SEC-JS-001", "SEC-JS-008"]),
    ],
)
def test_javascript_rules(source, want):
    assert found(source, "javascript") == want


CHOICES = (
    ("python", "def h(v, flag):\n    if flag:\n        return v\ndef f(a):\n    x = a\n    g(x)\n    h(x, True)\n    return x\n    h(x, False)\n"),
    ("python", "def h(v, flag):\n    while flag:\n        break\ndef f(a):\n    h(\n        a,\n        False,\n    )\n    k(a).b = h(a, True)\n    return k(a).b or h(1, True)\n"),
    ("python", "def system(v, flag):\n    if flag:\n        return v\nother()\nsystem('x', True)\n"),
    ("python", "def system(v, flag):\n    if flag:\n        return v\nsystem('x', True)\n"),
    ("python", "class K:\n    on = h(1, True)\n    def m(self, flag):\n        try:\n            with o(True) as q:\n                self.m(True)\n        except E:\n            raise E(False)\n        x += n(True)\n        y: bool = n(False)\n        def inner(z):\n            if not z:\n                inner(True)\n        assert p(True), q(False)\n"),
    ("python", "def h(v, flag):\r    if flag:\r        return v\rdef f(a):\r    a\r    h(a, True)\r"),
    ("python", "def h(v, flag):\n    \"\"\"\n    True\n    \"\"\"\n    if flag: h(v, flag=False); h(lambda: h(1, True), True)\n"),
    ("python", "def f(:\n    h(True)\n"),
    ("javascript", "function h(v, flag) { if (flag) { return v } }\nfunction f(a) { h(a, true); g(a) }\n"),
)


@pytest.mark.parametrize(("language", "text"), CHOICES)
def test_constants_of_branches_without_the_values_of_other_statements(language, text):
    def rows(m, given):
        named = list(source_code._facts("p", source_code.Module(m.language, functions=m.functions)))
        return sorted(map(repr, given)), [r for r in named if r[0] == "function"], list(source_code._guards("p", m)), m.errors

    whole, thin = source_code.parse(language, text), source_code.parse_choices(language, text)
    assert rows(thin, source_code._choices("p", thin)) == rows(whole, [r for r in source_code._flows("p", whole) if r[1] == "constant" and r[3] in ("True", "False")])


def test_functions_without_constants_are_not_folded(monkeypatch):
    """In a file with one call of a constant, only that call is read as a value, and only its function and the module are folded."""
    folded, plain = [], source_code.flow.Fold
    monkeypatch.setattr(source_code.flow, "Fold", lambda language, f: folded.append(f.name) or plain(language, f))
    m = source_code.parse_choices("python", "def h(v, flag):\n    if flag:\n        return v\ndef f(a):\n    g(a)\n    x = k(a)\n    h(x, True)\n    return g(x)\n")
    assert [r[3:5] for r in source_code._choices("p", m)] == [("True", "h")] and folded == ["f", "<module>"]
    assert [s.value is not None for s in m.functions[1].body] == [False, False, True, False]
