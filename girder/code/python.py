"""Python source to the common tree, by the standard library's parser."""

from __future__ import annotations

import ast
import re
import warnings

from girder.code.ir import Class, Expr, Function, Import, Module, Param, Stmt, calls

_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class _Reader:
    """``marked``: lines of which the values of functions' statements are asked for; None: all."""

    def __init__(self, marked: set[int] | None = None):
        self.module, self.marked = Module("python"), marked

    # expressions

    def expr(self, x: ast.AST | None) -> Expr | None:
        if x is None:
            return None
        line = getattr(x, "lineno", 0)
        match x:
            case ast.Name():
                return Expr("name", x.id, line=line)
            case ast.Constant():
                return Expr("const", type(x.value).__name__, value=x.value, line=line)
            case ast.Attribute():
                return Expr("attr", x.attr, (self.expr(x.value),), line=line)
            case ast.Subscript():
                return Expr("index", "", (self.expr(x.value), self.expr(x.slice)), line=line)
            case ast.Call():
                named = [k for k in x.keywords if k.arg]
                rest = [self.expr(k.value) for k in x.keywords if not k.arg]
                args = [self.expr(a) for a in x.args] + rest
                return Expr("call", "", (self.expr(x.func), *args, *[self.expr(k.value) for k in named]), tuple(k.arg for k in named), line=line)
            case ast.BoolOp():
                return Expr("and" if isinstance(x.op, ast.And) else "or", "", tuple(map(self.expr, x.values)), line=line)
            case ast.UnaryOp() if isinstance(x.op, ast.Not):
                return Expr("not", "", (self.expr(x.operand),), line=line)
            case ast.Compare():
                pairs, left = [], self.expr(x.left)
                for op, right in zip(x.ops, x.comparators, strict=True):
                    right = self.expr(right)
                    pairs.append(Expr("compare", _COMPARE[type(op)], (left, right), line=line))
                    left = right
                return pairs[0] if len(pairs) == 1 else Expr("and", "", tuple(pairs), line=line)
            case ast.BinOp():
                parts = (self.expr(x.left), self.expr(x.right))
                return Expr("concat" if isinstance(x.op, ast.Add | ast.Mod) else "other", type(x.op).__name__, parts, line=line)
            case ast.JoinedStr():
                return Expr("concat", "fstring", tuple(self.expr(v.value if isinstance(v, ast.FormattedValue) else v) for v in x.values), line=line)
            case ast.List() | ast.Tuple() | ast.Set():
                return Expr("list", type(x).__name__.lower(), tuple(map(self.expr, x.elts)), line=line)
            case ast.Dict():
                pairs = [(k, v) for k, v in zip(x.keys, x.values, strict=True)]
                return Expr("object", "dict", tuple(self.expr(v) for _, v in pairs), tuple(str(k.value) if isinstance(k, ast.Constant) else "*" if k is None else ast.unparse(k) for k, _ in pairs), line=line)
            case ast.IfExp():
                return Expr("other", "choice", (self.expr(x.test), self.expr(x.body), self.expr(x.orelse)), line=line)
            case ast.Lambda():
                return Expr("function", "lambda", line=line)
            case ast.Starred():
                return Expr("spread", "", (self.expr(x.value),), line=line)
            case ast.NamedExpr():
                return self.expr(x.value)
        inner = [c for c in ast.iter_child_nodes(x) if isinstance(c, ast.expr)]
        return Expr("other", type(x).__name__, tuple(map(self.expr, inner)), line=line)

    # statements

    def block(self, body: list[ast.stmt], scope: str, owner: str = "") -> list[Stmt]:
        return [s for x in body for s in self.stmt(x, scope, owner)]

    def valued(self, x: ast.stmt, scope: str) -> bool:
        return self.marked is None or not scope or not self.marked.isdisjoint(range(x.lineno, (x.end_lineno or x.lineno) + 1))

    def stmt(self, x: ast.stmt, scope: str, owner: str) -> list[Stmt]:
        line, end = x.lineno, x.end_lineno or x.lineno
        inside = lambda b: self.block(b, scope, owner)
        match x:  # the most frequent first
            case ast.Import():
                self.module.imports += [Import(a.name, ((a.name, a.asname or a.name.split(".")[0]),), "static", line) for a in x.names]
                return [Stmt("pass", line, end=end)]
            case ast.ImportFrom():
                self.module.imports.append(Import(x.module or "", tuple((a.name, a.asname or a.name) for a in x.names), "from", line, x.level))
                return [Stmt("pass", line, end=end)]
            case ast.Expr():
                return [Stmt("expr", line, value=self.expr(x.value) if self.valued(x, scope) else None, end=end)]
            case ast.Assign():
                return [Stmt("assign", line, tuple(map(self.expr, x.targets)), self.expr(x.value) if self.valued(x, scope) else None, end=end)]
            case ast.AnnAssign():
                return [Stmt("assign", line, (self.expr(x.target),), self.expr(x.value) if self.valued(x, scope) else None, end=end, annotation=ast.unparse(x.annotation))]
            case ast.AugAssign():
                target = self.expr(x.target)
                if not self.valued(x, scope):
                    return [Stmt("assign", line, (target,), end=end, augmented=True)]
                kind = "concat" if isinstance(x.op, ast.Add | ast.Mod) else "other"
                return [Stmt("assign", line, (target,), Expr(kind, type(x.op).__name__, (target, self.expr(x.value)), line=line), end=end, augmented=True)]
            case ast.If():
                return [Stmt("if", line, value=self.expr(x.test), body=inside(x.body), orelse=inside(x.orelse), end=end)]
            case ast.While():
                return [Stmt("loop", line, value=self.expr(x.test), body=inside(x.body), orelse=inside(x.orelse), end=end)]
            case ast.For() | ast.AsyncFor():
                return [Stmt("loop", line, (self.expr(x.target),), self.expr(x.iter), inside(x.body), inside(x.orelse), end=end)]
            case ast.Return():
                return [Stmt("return", line, value=self.expr(x.value) if self.valued(x, scope) else None, end=end)]
            case ast.Raise():
                return [Stmt("raise", line, value=self.expr(x.exc) if self.valued(x, scope) else None, end=end)]
            case ast.Break():
                return [Stmt("break", line, end=end)]
            case ast.Continue():
                return [Stmt("continue", line, end=end)]
            case ast.Try() | ast.TryStar():
                handlers = [(ast.unparse(h.type) if h.type else "", inside(h.body)) for h in x.handlers]
                return [Stmt("try", line, body=inside(x.body), orelse=inside(x.orelse), handlers=handlers, final=inside(x.finalbody), end=end)]
            case ast.With() | ast.AsyncWith():
                heads = [Stmt("assign", line, (self.expr(i.optional_vars),), self.expr(i.context_expr), end=line) if i.optional_vars else Stmt("expr", line, value=self.expr(i.context_expr), end=line) for i in x.items]
                return [*heads, Stmt("block", line, body=inside(x.body), end=end)]
            case ast.Match():
                out: list[Stmt] = []
                for case in reversed(x.cases):
                    out = [Stmt("if", case.pattern.lineno, value=Expr("other", "match", (self.expr(x.subject),), line=line), body=inside(case.body), orelse=out, end=end)]
                return out
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                return [self.function(x, scope, owner)]
            case ast.ClassDef():
                return [self.klass(x, scope)]
            case ast.Assert():
                return [Stmt("if", line, value=Expr("not", "", (self.expr(x.test),), line=line), body=[Stmt("raise", line, value=Expr("name", "AssertionError", line=line), end=end)], end=end)]
        return [Stmt("pass", line, end=end)]

    def function(self, x: ast.FunctionDef | ast.AsyncFunctionDef, scope: str, owner: str) -> Stmt:
        name = f"{scope}.{x.name}" if scope else x.name
        a = x.args
        ordered = [*a.posonlyargs, *a.args]
        defaults: list[ast.expr | None] = [None] * (len(ordered) - len(a.defaults)) + list(a.defaults)
        params = [Param(p.arg, ast.unparse(p.annotation) if p.annotation else "", ast.unparse(d) if d is not None else None) for p, d in zip(ordered, defaults, strict=True)]
        params += [Param(p.arg, ast.unparse(p.annotation) if p.annotation else "", ast.unparse(d) if d is not None else None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        at = len(self.module.functions)
        body = self.block(x.body, name)
        f = Function(x.name, name, params, body, x.lineno, x.end_lineno or x.lineno, [self.expr(d) for d in x.decorator_list], owner, ast.unparse(x.returns) if x.returns else "")
        self.module.functions.insert(at, f)
        if not x.name.startswith("_"):
            self.module.exports.append((x.name, "function", x.lineno))
        return Stmt("def", x.lineno, (Expr("name", x.name, line=x.lineno),), end=x.end_lineno or x.lineno)

    def klass(self, x: ast.ClassDef, scope: str) -> Stmt:
        name = f"{scope}.{x.name}" if scope else x.name
        body = self.block(x.body, name, name)
        fields = tuple(t.name for s in body if s.kind == "assign" for t in s.targets if t.kind == "name")
        self.module.classes.append(Class(name, x.lineno, x.end_lineno or x.lineno, tuple(ast.unparse(b) for b in x.bases), fields))
        if not x.name.startswith("_"):
            self.module.exports.append((x.name, "class", x.lineno))
        return Stmt("def", x.lineno, (Expr("name", x.name, line=x.lineno),), body=body, end=x.end_lineno or x.lineno)


def _by_call(source: str) -> bool:
    """Whether a text may import by a call; identifiers beyond ASCII can spell a name in other letters."""
    return "import_module" in source or "__import__" in source or not source.isascii()


def read_imports(source: str) -> Module:
    """A module with its imports and errors alone: expressions are passed over where none can import."""
    if _by_call(source):
        return read(source)
    reader = _Reader()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            left: list[ast.AST] = list(ast.parse(source).body)
    except (SyntaxError, ValueError, RecursionError) as e:
        return Module("python", errors=[(type(e).__name__, getattr(e, "lineno", None) or 1)])
    for x in left:  # grows on the way
        if isinstance(x, ast.Import | ast.ImportFrom):
            reader.stmt(x, "", "")
        else:
            for part in ("body", "orelse", "handlers", "finalbody", "cases"):
                inner = getattr(x, part, None)
                if isinstance(inner, list):
                    left += inner
    reader.module.imports.sort(key=lambda i: i.line)
    return reader.module


def read_marked(source: str, words: str) -> Module:
    """A module in which simple statements of functions have values only if a match of the pattern stands on their lines; all else is whole."""
    if "\r" in source:  # lines would count otherwise
        return read(source)
    return read(source, {source.count("\n", 0, x.start()) + 1 for x in re.finditer(words, source)})


def read(source: str, marked: set[int] | None = None) -> Module:
    """The module of a source text; one with a syntax error has that error and nothing else."""
    reader = _Reader(marked)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        reader.module.body = reader.block(tree.body, "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return Module("python", errors=[(type(e).__name__, getattr(e, "lineno", None) or 1)])
    # imports by call, with a literal name
    for e in [] if not _by_call(source) else [e for body in [reader.module.body, *[f.body for f in reader.module.functions]] for e in calls(body)]:
        if e.callee in ("__import__", "importlib.import_module", "import_module") and e.args and isinstance(e.args[0].value, str):
            reader.module.imports.append(Import(e.args[0].value, (), "dynamic", e.line))
    reader.module.imports.sort(key=lambda i: i.line)
    return reader.module
