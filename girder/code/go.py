"""Go declarations: imports, functions and methods, types, by a reader over tokens."""

from __future__ import annotations

import re

from girder.code.ir import Class, Function, Import, Module, Param

_TOKEN = re.compile(r"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<other>.)", re.S)


def read(source: str) -> Module:
    """Bodies are passed over; names with a capital are exported."""
    module = Module("go")
    toks: list[tuple[str, str, int]] = []
    line = 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup == "line":
            toks.append(("line", "\n", line))
        elif m.lastgroup not in ("space", "comment"):
            toks.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
    toks.append(("end", "", line))

    def group(i: int) -> int:
        """The place after the bracketed group that begins at i."""
        depth = 0
        while toks[i][0] != "end":
            depth += toks[i][1] in ("(", "[", "{") and toks[i][0] == "other"
            depth -= toks[i][1] in (")", "]", "}") and toks[i][0] == "other"
            i += 1
            if depth == 0:
                break
        return i

    def flat(a: int, b: int) -> list[str]:
        return [t[1] for t in toks[a:b] if t[0] != "line"]

    def params(words: list[str]) -> list[Param]:
        out, part, depth = [], [], 0
        for w in [*words, ","]:
            depth += w in ("(", "[", "{")
            depth -= w in (")", "]", "}")
            if w == "," and depth == 0:
                if part:
                    out.append(Param(part[0], "".join(part[1:])))
                part = []
            else:
                part.append(w)
        for k in range(len(out) - 1, 0, -1):  # a, b int: the type of the last is that of all before it
            if not out[k - 1].annotation:
                out[k - 1].annotation = out[k].annotation
        return out

    i = 0
    while toks[i][0] != "end":
        kind, text, at = toks[i]
        if kind == "name" and text == "import":
            j = i + 1
            end = group(j) if toks[j][1] == "(" else next(k for k in range(j, len(toks)) if toks[k][0] in ("line", "end"))
            for k in range(j, end):
                if toks[k][0] == "string":
                    path, before = toks[k][1].strip('"`'), toks[k - 1]
                    local = before[1] if before[1] == "." or before[0] == "name" and before[1] != "import" else path.rsplit("/", 1)[-1]
                    module.imports.append(Import(path, ((path, local),), "static", toks[k][2]))
            i = end
        elif kind == "name" and text == "func":
            j, owner = i + 1, ""
            if toks[j][1] == "(":
                end = group(j)
                owner = "".join(w for w in flat(j + 1, end - 1)[1:] if w != "*").split("[")[0]
                j = end
            name = toks[j][1] if toks[j][0] == "name" else ""
            j += 1
            if toks[j][1] == "[":
                j = group(j)
            if not name or toks[j][1] != "(":
                module.errors.append(("func", at))
                i += 1
                continue
            end = group(j)
            inputs = params(flat(j + 1, end - 1))
            k = end
            while toks[k][0] not in ("line", "end") and toks[k][1] != "{":
                k = group(k) if toks[k][1] in ("(", "[") else k + 1
            returns = "".join(flat(end, k))
            stop = group(k) if toks[k][1] == "{" else k
            module.functions.append(Function(name, f"{owner}.{name}".lstrip("."), inputs, [], at, toks[max(stop - 1, i)][2], owner=owner, returns=returns))
            if name[0].isupper():
                module.exports.append((name, "function", at))
            i = stop
        elif kind == "name" and text == "type":
            j = i + 1
            ends = group(j) if toks[j][1] == "(" else None
            while toks[j][0] != "end" and (ends is None or j < ends):
                if toks[j][0] == "name":
                    name, line_, k = toks[j][1], toks[j][2], j + 1
                    if toks[k][1] == "[":
                        k = group(k)
                    fields: tuple[str, ...] = ()
                    if toks[k][1] in ("struct", "interface") and toks[k + 1][1] == "{":
                        stop = group(k + 1)
                        rows = [toks[x] for x in range(k + 2, stop - 1)]
                        fields = tuple(t[1] for n, t in enumerate(rows) if t[0] == "name" and (n == 0 or rows[n - 1][0] == "line"))
                    else:
                        stop = next(x for x in range(k, len(toks)) if toks[x][0] in ("line", "end"))
                    module.classes.append(Class(name, line_, toks[stop - 1][2], (toks[k][1],), fields))
                    if name[0].isupper():
                        module.exports.append((name, "class", line_))
                    j = stop
                    if ends is None:
                        break
                else:
                    j += 1
            i = j
        elif text in ("(", "{", "[") and kind == "other":
            i = group(i)
        else:
            i += 1
    return module
