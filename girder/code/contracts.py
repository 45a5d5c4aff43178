"""Contracts of functions: what they need of their parameters, what holds when they return or raise, and what they change."""

from __future__ import annotations

import hashlib
import json

from girder.code.flow import summaries
from girder.code.guards import conditions
from girder.code.ir import Function, Module, calls, dotted, show, statements

#: Limits of a contract, and calls that a pure function may not make.
MOST_PRE, MOST_POST, MOST_EFFECTS = 8, 16, 16
EFFECTS = frozenset(("print", "open", "input", "exec", "eval", "execute", "executemany", "system", "popen", "run", "Popen", "write", "writeln", "fetch", "append", "push", "setItem", "commit", "log"))


def _pure(f: Function) -> bool:
    for s in statements(f.body):
        if s.kind == "assign" and any(t.kind in ("attr", "index") for t in s.targets):
            return False
    return not any(c.callee.rsplit(".", 1)[-1] in EFFECTS for c in calls(f.body))


def _returns(f: Function) -> list[tuple[str, str, str, int]]:
    out, inputs = [], {n: i for i, n in enumerate(f.inputs)}
    for s in statements(f.body):
        if s.kind != "return":
            continue
        v = s.value
        if v is None or (v.kind == "const" and v.name == "NoneType"):
            out.append(("returns", "NONE", "", s.line))
        elif v.kind == "const":
            out.append(("returns", "CONSTANT", repr(v.value), s.line))
        elif v.kind == "name" and v.name in inputs:
            out.append(("returns", "PARAMETER", str(inputs[v.name]), s.line))
        elif v.kind == "attr" and dotted(v).split(".")[0] in inputs:
            out.append(("returns", "FIELD", f"{inputs[dotted(v).split('.')[0]]}.{v.name}", s.line))
        elif v.kind == "object":
            out.append(("returns", "CONTAINER", ",".join(sorted(v.keys)[:16]), s.line))
        elif v.kind in ("new", "call") and (v.kind == "new" or v.callee.rsplit(".", 1)[-1][:1].isupper()):
            out.append(("returns", "FRESH", v.callee, s.line))
        else:
            out.append(("returns", "VALUE", "", s.line))
    return out


def _checks(f: Function) -> tuple[list[tuple[str, str, str, int]], list[tuple[str, str, str, int]]]:
    """What a function raises, and what holds of its parameters since it would have raised otherwise."""
    rows: list[tuple[str, str, str, int]] = []
    post: list[tuple[str, str, str, int]] = []
    inputs = {n: i for i, n in enumerate(f.inputs)}
    for s in statements(f.body):
        if s.kind == "if" and (raised := next((x for x in s.body if x.kind == "raise"), None)) is not None:
            name = raised.value.callee if raised.value is not None and raised.value.kind in ("call", "new") else show(raised.value)
            rows.append(("raises", name or "Exception", show(s.value), s.line))
            for fact in conditions(s.value, False)[1]:
                if fact.variable in inputs:
                    post.append(("ensures", str(inputs[fact.variable]), f"{fact.kind}:{fact.value}".rstrip(":"), s.line))
    return rows, post


def ensured(module: Module) -> list[tuple[str, str, str, str, int]]:
    """The rows of ``contracts`` of the kind ``ensures``, without a fold of the functions."""
    return [(f.qualified, *r) for f in module.functions for r in _checks(f)[1][:MOST_POST]]


def contracts(module: Module) -> list[tuple[str, str, str, str, int]]:
    """(function, kind, name, detail, line).

    ``requires``: a parameter reaches a sink, so callers must give it safe for the category; ``ensures``: on every normal
    return a fact holds of a parameter, since the function raises otherwise; ``raises``: an exception and its condition;
    ``effect``: a parameter's taint reaches the result; ``returns``: what the result is; ``pure``; ``hash``.
    """
    out: list[tuple[str, str, str, str, int]] = []
    known = {s.function: s for s in summaries(module)}
    for f in module.functions:
        rows: list[tuple[str, str, str, int]] = []
        if s := known.get(f.qualified):
            needs = sorted({(int(h.origin[6:]), h.category, h.line) for h in s.hits if h.origin.startswith("param:")})
            rows += [("requires", str(i), category, line) for i, category, line in needs[:MOST_PRE]]
            effects = sorted((int(k[6:]), "+".join(sorted(w.clean))) for k, w in s.returns.items() if k.startswith("param:"))
            rows += [("effect", str(i), clean or "TAINT", f.line) for i, clean in effects[:MOST_EFFECTS]]
        raised, post = _checks(f)
        rows += raised
        rows += post[:MOST_POST] + _returns(f)
        rows.append(("pure", str(_pure(f)).lower(), "", f.line))
        # lines are no part of what a caller relies on
        text = json.dumps(sorted({r[:3] for r in rows}), separators=(",", ":"))
        rows.append(("hash", hashlib.sha256(text.encode()).hexdigest(), "", f.line))
        out += [(f.qualified, *r) for r in rows]
    return out
