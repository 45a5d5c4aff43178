"""One small tree for function bodies of every language, on which flow, alias and contract analyses are written once.

Front ends (``python``, ``javascript``) turn source text into a ``Module``. Expressions keep what analyses ask for:
names, constants, member access, calls with their arguments, and for everything else an operator with its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(slots=True)
class Expr:
    """``kind``: name, const, attr, index, call, new, and, or, not, compare, concat, list, object, function, spread, other.

    ``name``: the identifier, member, operator or type of constant. ``parts``: operands; of a call the callee and then the
    arguments; of an object the values. ``keys``: of a call the names of its last arguments, of an object its keys.
    """

    kind: str
    name: str = ""
    parts: tuple[Expr, ...] = ()
    keys: tuple[str, ...] = ()
    value: Any = None
    line: int = 0

    @property
    def callee(self) -> str:
        return dotted(self.parts[0]) if self.kind in ("call", "new") else ""

    @property
    def args(self) -> tuple[Expr, ...]:
        """Arguments by position."""
        return self.parts[1 : len(self.parts) - len(self.keys)]

    @property
    def keywords(self) -> dict[str, Expr]:
        return dict(zip(self.keys, self.parts[len(self.parts) - len(self.keys) :], strict=True)) if self.kind in ("call", "new") else {}


@dataclass(slots=True)
class Stmt:
    """``kind``: assign, expr, if, loop, return, raise, break, continue, try, block, def, pass."""

    kind: str
    line: int = 0
    targets: tuple[Expr, ...] = ()
    value: Expr | None = None
    body: list[Stmt] = field(default_factory=list)
    orelse: list[Stmt] = field(default_factory=list)
    handlers: list[tuple[str, list[Stmt]]] = field(default_factory=list)
    final: list[Stmt] = field(default_factory=list)
    end: int = 0
    augmented: bool = False
    annotation: str = ""


@dataclass(slots=True)
class Param:
    name: str
    annotation: str = ""
    default: str | None = None


@dataclass(slots=True)
class Function:
    name: str
    qualified: str
    params: list[Param]
    body: list[Stmt]
    line: int
    end: int
    decorators: list[Expr] = field(default_factory=list)
    owner: str = ""
    returns: str = ""

    @property
    def inputs(self) -> list[str]:
        """Names of the parameters that a caller fills by position."""
        return [p.name for p in self.params if p.name not in ("self", "cls", "this")]


@dataclass(slots=True)
class Import:
    """``kind``: static, from, dynamic, require, export; ``names``: (name, local name); '*' for all."""

    module: str
    names: tuple[tuple[str, str], ...]
    kind: str
    line: int
    level: int = 0


@dataclass(slots=True)
class Class:
    name: str
    line: int
    end: int
    bases: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


@dataclass(slots=True)
class Module:
    language: str
    imports: list[Import] = field(default_factory=list)
    exports: list[tuple[str, str, int]] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    body: list[Stmt] = field(default_factory=list)
    errors: list[tuple[str, int]] = field(default_factory=list)
    attributes: list[tuple[str, Expr, int]] = field(default_factory=list)  # of markup: name, value, line


def dotted(e: Expr) -> str:
    """a.b.c of a chain of members; '' for anything else at its root."""
    if e.kind == "name":
        return e.name
    if e.kind == "attr":
        base = dotted(e.parts[0])
        return f"{base}.{e.name}" if base else f"?.{e.name}"
    return ""


def show(e: Expr | None) -> str:
    """An expression as short text, equal for equal trees."""
    if e is None:
        return ""
    p = [show(x) for x in e.parts]
    match e.kind:
        case "name":
            return e.name
        case "const":
            return repr(e.value)
        case "attr":
            return f"{p[0]}.{e.name}"
        case "index":
            return f"{p[0]}[{p[1]}]"
        case "call" | "new":
            n = len(p) - len(e.keys)
            named = [f"{k}={v}" for k, v in zip(e.keys, p[n:], strict=True)]
            return ("new " if e.kind == "new" else "") + f"{p[0]}({', '.join(p[1:n] + named)})"
        case "not":
            return f"not {p[0]}"
        case "and" | "or":
            return f" {e.kind} ".join(p)
        case "compare":
            return f"{p[0]} {e.name} {p[1]}"
        case "concat":
            return "(" + " + ".join(p) + ")"
        case "list":
            return "[" + ", ".join(p) + "]"
        case "object":
            return "{" + ", ".join(f"{k}: {v}" for k, v in zip(e.keys, p, strict=True)) + "}"
        case "function":
            return "<function>"
    return f"{e.name}({', '.join(p)})"


def walk(e: Expr | None) -> Iterator[Expr]:
    """An expression and all below it, parents first."""
    left = [e]
    while left:
        if (x := left.pop()) is not None:
            yield x
            left.extend(reversed(x.parts))


def statements(body: list[Stmt]) -> Iterator[Stmt]:
    """All statements of a body, in source order, without those of functions defined in it."""
    for s in body:
        yield s
        if s.kind != "def":
            yield from statements(s.body)
            for _, h in s.handlers:
                yield from statements(h)
            yield from statements(s.orelse)
            yield from statements(s.final)


def expressions(body: list[Stmt]) -> Iterator[Expr]:
    for s in statements(body):
        for t in s.targets:
            yield from walk(t)
        yield from walk(s.value)


def calls(body: list[Stmt]) -> Iterator[Expr]:
    return (e for e in expressions(body) if e.kind in ("call", "new"))
