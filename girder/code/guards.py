"""What a branch condition says about variables: predicates for path feasibility, and facts that make values safe."""

from __future__ import annotations

import re
from dataclasses import dataclass

from girder.code.ir import Expr, dotted, show
from girder.code.registry import COMMAND, DOM, EVAL, SQL

#: Validators that are trusted by name.
VALIDATORS = frozenset(("is_valid", "validate_id", "is_safe_int", "is_safe_token", "is_valid_email", "is_alphanumeric"))
#: What is safe for a category: types and formats.
SAFE_TYPES = {SQL: {"int", "float", "bool", "integer", "number"}, DOM: {"int", "float", "bool", "number", "boolean"}, EVAL: {"int", "float", "bool", "number", "boolean"}, COMMAND: set()}
SAFE_FORMATS = {SQL: {"numeric"}, COMMAND: {"alphanumeric", "numeric"}, DOM: {"numeric", "alphanumeric"}, EVAL: {"numeric"}}


@dataclass(frozen=True, slots=True)
class Condition:
    """``op``: IS_INSTANCE, IS_DIGIT, IS_ALNUM, IS_NONE, IS_NOT_NONE, EQUALS, NOT_EQUALS, REGEX, VALIDATOR, TRUTHY."""

    variable: str
    op: str
    expected: bool
    literal: str = ""
    line: int = 0


@dataclass(frozen=True, slots=True)
class Fact:
    """``kind``: type, numeric, alphanumeric, not_none, sanitized; ``value``: the type or the category."""

    variable: str
    kind: str
    value: str = ""
    line: int = 0

    @property
    def safe_for(self) -> frozenset[str]:
        if self.kind == "sanitized":
            return frozenset((self.value,))
        held = SAFE_TYPES if self.kind == "type" else SAFE_FORMATS
        names = set(self.value.lower().split("|")) if self.kind == "type" else {self.kind}
        return frozenset(c for c, ok in held.items() if names and names <= ok)


def _variable(e: Expr) -> str:
    return dotted(e) if e.kind in ("name", "attr") else ""


def _types(e: Expr) -> str:
    if e.kind == "list":
        return "|".join(sorted(filter(None, (dotted(x) for x in e.parts))))
    return dotted(e)


def _regex(pattern: str, variable: str, expected: bool, line: int) -> tuple[list[Condition], list[Fact]]:
    """Only a pattern anchored at both ends says something of the whole value."""
    if not variable or not pattern.startswith(("^", "\\A")) or not pattern.endswith(("$", "\\Z", "\\z")):
        return [], []
    inner = pattern.removeprefix("^").removeprefix("\\A").removesuffix("$").removesuffix("\\Z").removesuffix("\\z")
    facts = []
    if expected:
        facts.append(Fact(variable, "not_none", "", line))
        if re.fullmatch(r"(\\d|\[0-9\])(\+|\{\d+(,\d*)?\})", inner):
            facts.append(Fact(variable, "numeric", "", line))
        elif re.fullmatch(r"(\\w|\[(a-z|A-Z|0-9|_|\\d|\\w)+\])(\+|\{\d+(,\d*)?\})", inner):
            facts.append(Fact(variable, "alphanumeric", "", line))
    return [Condition(variable, "REGEX", expected, pattern, line)], facts


def _call(e: Expr, expected: bool) -> tuple[list[Condition], list[Fact]]:
    name, args, line = e.callee, e.args, e.line
    first = _variable(args[0]) if args else ""
    short = name.rsplit(".", 1)[-1]
    receiver = name.rpartition(".")[0]
    if name == "isinstance" and len(args) > 1 and first and _types(args[1]):
        return [Condition(first, "IS_INSTANCE", expected, _types(args[1]), line)], [Fact(first, "type", _types(args[1]), line)] if expected else []
    if short in ("isdigit", "isnumeric", "isdecimal") and receiver:
        return [Condition(receiver, "IS_DIGIT", expected, "", line)], [Fact(receiver, "numeric", "", line)] if expected else []
    if short == "isalnum" and receiver:
        return [Condition(receiver, "IS_ALNUM", expected, "", line)], [Fact(receiver, "alphanumeric", "", line)] if expected else []
    if name in ("re.match", "re.fullmatch") and len(args) > 1 and isinstance(args[0].value, str):
        return _regex(args[0].value, _variable(args[1]), expected, line)
    if short == "test" and e.parts[0].kind == "attr" and e.parts[0].parts[0].name == "regex" and first:
        return _regex(str(e.parts[0].parts[0].value).strip("/").rsplit("/", 1)[0], first, expected, line)
    if name in ("Number.isInteger", "Number.isFinite", "Number.isSafeInteger") and first:
        return [Condition(first, "IS_INSTANCE", expected, "number", line)], [Fact(first, "type", "number", line)] if expected else []
    if name in ("shlex.quote", "quote") and first:
        return [], [Fact(first, "sanitized", COMMAND, line)] if expected else []
    if short in VALIDATORS and first:
        kind = "numeric" if "int" in short else "alphanumeric"
        return [Condition(first, "VALIDATOR", expected, short, line)], [Fact(first, kind, "", line)] if expected else []
    return [], []


def _compare(e: Expr, expected: bool) -> tuple[list[Condition], list[Fact]]:
    left, right = e.parts
    if left.kind == "const" and right.kind != "const":
        left, right = right, left
    if left.kind == "other" and left.name == "typeof" and isinstance(right.value, str) and e.name in ("==", "===", "!=", "!=="):
        variable, holds = _variable(left.parts[0]), expected == (e.name[0] == "=")
        return ([Condition(variable, "IS_INSTANCE", holds, right.value, e.line)], [Fact(variable, "type", right.value, e.line)] if holds else []) if variable else ([], [])
    variable = _variable(left)
    if not variable or right.kind != "const":
        return [], []
    if right.name == "NoneType":
        none = e.name in ("is", "==", "===")
        if none == expected:
            return [Condition(variable, "IS_NONE", True, "", e.line)], []
        return [Condition(variable, "IS_NOT_NONE", True, "", e.line)], [Fact(variable, "not_none", "", e.line)]
    if e.name in ("==", "===", "!=", "!=="):
        equal = e.name[0] == "="
        return [Condition(variable, "EQUALS", expected == equal, repr(right.value), e.line)], []
    return [], []


def conditions(e: Expr | None, expected: bool = True) -> tuple[list[Condition], list[Fact]]:
    """What holds when the condition comes out as expected. An 'and' that fails and an 'or' that holds say nothing of their parts."""
    if e is None:
        return [], []
    if e.kind == "not":
        return conditions(e.parts[0], not expected)
    if e.kind in ("and", "or"):
        out: tuple[list[Condition], list[Fact]] = ([], [])
        if expected == (e.kind == "and"):
            for x in e.parts:
                c, f = conditions(x, expected)
                out[0].extend(c)
                out[1].extend(f)
        return out
    if e.kind == "call":
        return _call(e, expected)
    if e.kind == "compare":
        return _compare(e, expected)
    if variable := _variable(e):
        return [Condition(variable, "TRUTHY", expected, "", e.line)], [Fact(variable, "not_none", "", e.line)] if expected else []
    return [], []


def infeasible(held: list[Condition]) -> str:
    """Why conditions can't hold together; '' if they may."""
    seen: dict[tuple[str, str, str], bool] = {}
    none: dict[str, set[str]] = {}
    types: dict[str, set[str]] = {}
    equal: dict[str, str] = {}
    for c in held:
        if seen.setdefault((c.variable, c.op, c.literal), c.expected) != c.expected:
            return f"{c.variable} {c.op} both ways"
        if c.op in ("IS_NONE", "IS_NOT_NONE") and c.expected:
            none.setdefault(c.variable, set()).add(c.op)
            if len(none[c.variable]) == 2:
                return f"{c.variable} is None and is not"
        if c.op == "IS_INSTANCE" and c.expected:
            new = set(c.literal.lower().split("|"))
            old = types.setdefault(c.variable, new)
            number = {"int", "float", "number"}
            if not old & new and not (old & number and new & number):
                return f"{c.variable} is {'|'.join(sorted(old))} and {'|'.join(sorted(new))}"
        if c.op == "EQUALS" and c.expected and equal.setdefault(c.variable, c.literal) != c.literal:
            return f"{c.variable} equals two constants"
    return ""


def shown(e: Expr | None) -> str:
    return show(e)
