"""Points-to sets, fields of objects, types of variables, and scopes, in one fold over a function."""

from __future__ import annotations

from dataclasses import dataclass, field

from girder.code.ir import Expr, Function, Module, Stmt, dotted, walk

#: Limits of points-to sets and of fields of an object.
MOST_OBJECTS, MOST_FIELDS, LOOPS = 4, 16, 2
UNKNOWN = "?"


@dataclass(frozen=True, slots=True)
class Points:
    """Objects that a name may mean, sorted; ``truncated`` when there were more than fit."""

    objects: tuple[str, ...] = ()
    unknown: bool = False
    truncated: bool = False

    def __or__(self, other: Points) -> Points:
        every = sorted({*self.objects, *other.objects})
        return Points(tuple(every[:MOST_OBJECTS]), self.unknown or other.unknown, self.truncated or other.truncated or len(every) > MOST_OBJECTS)

    @property
    def one(self) -> bool:
        return len(self.objects) == 1 and not self.unknown and not self.truncated


NONE, ANY = Points(), Points((), True)


@dataclass(slots=True)
class World:
    """What names mean and what fields hold at a place."""

    names: dict[str, Points] = field(default_factory=dict)
    fields: dict[tuple[str, str], Points] = field(default_factory=dict)
    types: dict[str, frozenset[str]] = field(default_factory=dict)

    def copy(self) -> World:
        return World(dict(self.names), dict(self.fields), dict(self.types))

    def __or__(self, other: World) -> World:
        """The union of both sides; a name or field that only one side has may be unset, and stays as that side has it."""
        both = lambda a, b: {k: a[k] | b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}
        return World(both(self.names, other.names), both(self.fields, other.fields), both(self.types, other.types))

    def write(self, receiver: Points, name: str, value: Points) -> str:
        """A single receiver's field is overwritten, those of several get the value besides."""
        for o in receiver.objects:
            held = sum(k[0] == o for k in self.fields)
            if (o, name) not in self.fields and held >= MOST_FIELDS:
                continue
            self.fields[o, name] = value if receiver.one else self.fields.get((o, name), ANY) | value
        return "STRONG" if receiver.one else "WEAK"

    def read(self, receiver: Points, name: str) -> Points:
        out = ANY if receiver.unknown or not receiver.objects else NONE
        for o in receiver.objects:
            out |= self.fields.get((o, name), ANY)
        return out


_OF_CONSTANT = {"str": "str", "int": "int", "float": "float", "bool": "bool", "number": "number", "regex": "RegExp", "bytes": "bytes"}


class Fold:
    """Rows (kind, name, detail, line): points_to, field, alias, type, receiver."""

    def __init__(self, function: Function, classes: set[str]):
        self.function, self.classes = function, classes
        self.rows: list[tuple[str, str, str, int]] = []
        self.world = World()
        for i, p in enumerate(function.params):
            self.world.names[p.name] = Points((f"self:{function.owner}",)) if p.name in ("self", "this") else Points((f"param:{i}",))
            if p.annotation:
                self.world.types[p.name] = frozenset((p.annotation,))
                self.row("type", p.name, p.annotation, function.line)
        if function.owner and "this" not in self.world.names:
            self.world.names["this"] = Points((f"self:{function.owner}",))

    def row(self, kind: str, name: str, detail: str, line: int) -> None:
        if (kind, name, detail, line) not in self.rows:
            self.rows.append((kind, name, detail, line))

    def value(self, e: Expr | None) -> tuple[Points, frozenset[str]]:
        if e is None:
            return ANY, frozenset()
        match e.kind:
            case "name":
                return self.world.names.get(e.name, ANY), self.world.types.get(e.name, frozenset())
            case "const":
                kind = _OF_CONSTANT.get(e.name)
                return NONE, frozenset((kind,)) if kind else frozenset(("None",))
            case "list" | "object":
                made = f"{e.name or e.kind}@{e.line}"
                if e.kind == "object":
                    for k, x in zip(e.keys, e.parts, strict=True):
                        self.world.fields[made, k] = self.value(x)[0]
                return Points((made,)), frozenset((e.name or e.kind,))
            case "attr":
                receiver, _ = self.value(e.parts[0])
                return self.world.read(receiver, e.name), frozenset()
            case "new":
                return Points((f"{e.callee}@{e.line}",)), frozenset((e.callee,))
            case "call":
                last = e.callee.rsplit(".", 1)[-1]
                if last in self.classes or (last[:1].isupper() and last[1:2].islower()):
                    return Points((f"{e.callee}@{e.line}",)), frozenset((last,))
                if last in ("int", "float", "str", "bool", "list", "dict", "set", "tuple"):
                    return NONE, frozenset((last,))
                if e.parts[0].kind == "attr":
                    receiver = e.parts[0].parts[0]
                    types = self.value(receiver)[1]
                    if len(types) == 1:
                        self.row("receiver", e.callee, next(iter(types)), e.line)
                return ANY, frozenset()
            case "or" | "and":
                out, types = NONE, frozenset()
                for x in e.parts:
                    p, t = self.value(x)
                    out, types = out | p, types | t
                return out, types
            case "other" if e.name == "choice":
                (a, s), (b, t) = self.value(e.parts[1]), self.value(e.parts[2])
                return a | b, s | t
            case "concat":
                return NONE, frozenset(("str",)) if e.name in ("fstring", "template") else frozenset()
        return ANY, frozenset()

    def assign(self, target: Expr, e: Expr | None, line: int, annotation: str = "") -> None:
        points, types = self.value(e)
        if target.kind == "name":
            self.world.names[target.name] = points
            self.world.types[target.name] = frozenset((annotation,)) if annotation else types
            self.row("points_to", target.name, ",".join(points.objects) + ("?" if points.unknown else "") + ("+" if points.truncated else ""), line)
            if e is not None and e.kind == "name" and points.objects:
                self.row("alias", target.name, e.name, line)
            for t in sorted(self.world.types[target.name]):
                self.row("type", target.name, t, line)
        elif target.kind == "attr":
            receiver, _ = self.value(target.parts[0])
            how = self.world.write(receiver, target.name, points)
            self.row("field", f"{dotted(target.parts[0])}.{target.name}", how, line)
        elif target.kind in ("list", "object"):
            for p in target.parts:
                self.assign(p, None, line)

    def run(self, body: list[Stmt]) -> bool:
        for s in body:
            if s.value is not None:
                for x in walk(s.value):
                    if x.kind == "call":
                        self.value(x)
            match s.kind:
                case "assign":
                    for t in s.targets:
                        self.assign(t, s.value, s.line, s.annotation)
                case "if":
                    before, ends = self.world, []
                    for arm in (s.body, s.orelse):
                        self.world = before.copy()
                        if not self.run(arm):
                            ends.append(self.world)
                    if not ends:
                        return True
                    self.world = ends[0] if len(ends) == 1 else ends[0] | ends[1]
                case "loop":
                    for _ in range(LOOPS):
                        before = self.world.copy()
                        for t in s.targets:
                            self.assign(t, None, s.line)
                        self.run(s.body)
                        self.world = before | self.world
                    self.run(s.orelse)
                case "try":
                    before = self.world.copy()
                    self.run(s.body)
                    ends = [self.world]
                    for _, h in s.handlers:
                        self.world = before | ends[0]
                        if not self.run(h):
                            ends.append(self.world)
                    self.world = ends[0]
                    for w in ends[1:]:
                        self.world = self.world | w
                    self.run(s.final)
                case "block":
                    if self.run(s.body):
                        return True
                case "return" | "raise" | "break" | "continue":
                    return True
        return False


def facts(module: Module) -> list[tuple[str, str, str, str, int]]:
    """(function, kind, name, detail, line) of all functions."""
    classes = {c.name.rsplit(".", 1)[-1] for c in module.classes}
    out = []
    for f in module.functions:
        fold = Fold(f, classes)
        fold.run(f.body)
        out += [(f.qualified, *r) for r in fold.rows]
    return out


def definitions(module: Module) -> list[tuple[str, str, int, int, str]]:
    """(scope, name, line of the use, line of its definition, scope of the definition).

    A name is looked up in its own scope among definitions on earlier lines or the same, the last of them; in
    enclosing scopes any definition counts, the first.
    """
    from girder.code.ir import statements

    scopes: dict[str, dict[str, list[int]]] = {"": {}}

    def define(scope: str, name: str, line: int) -> None:
        scopes.setdefault(scope, {}).setdefault(name, []).append(line)

    def targets(t: Expr) -> list[str]:
        return [t.name] if t.kind == "name" else [n for p in t.parts for n in targets(p)] if t.kind in ("list", "object", "spread") else []

    bodies = [("", module.body), *[(f.qualified, f.body) for f in module.functions]]
    for i in module.imports:
        for _, local in i.names:
            define("", local, i.line)
    for f in module.functions:
        define(f.qualified.rpartition(".")[0], f.name, f.line)
        for p in f.params:
            define(f.qualified, p.name, f.line)
    for scope, body in bodies:
        for s in statements(body):
            for t in s.targets:
                for n in targets(t):
                    define(scope, n, s.line)
    out = []
    for scope, body in bodies:
        for s in statements(body):
            for e in walk(s.value):
                if e.kind != "name":
                    continue
                own = [x for x in scopes.get(scope, {}).get(e.name, []) if x <= e.line]
                if own:
                    out.append((scope, e.name, e.line, max(own), scope))
                    continue
                at = scope
                while at:
                    at = at.rpartition(".")[0]
                    if found := scopes.get(at, {}).get(e.name):
                        out.append((scope, e.name, e.line, min(found), at))
                        break
    return sorted(set(out))
