"""JavaScript and TypeScript source to the common tree: a tokenizer and a recursive reader of statements.

No parser for these languages is installed, so this one is written for what the analyses ask: modules, functions, classes,
control flow, assignments, calls, member access, template strings, and the attributes of JSX. Types are read past.
A statement that it can't read is noted as an error and skipped up to its end, so one odd line loses no other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from girder.code.ir import Class, Expr, Function, Import, Module, Param, Stmt, expressions

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v ﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)"""
    r"""|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<name>[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)"""
    r"""|(?P<punct>\.\.\.|=>|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.])""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", ";", "=>", "&&", "||", "??", "===", "!==", "==", "!=", "+", "-", "*", "%", "return", "typeof", "case", "in", "of", "void", "delete", "throw", "new"}
_KEYWORDS = {"if", "else", "for", "while", "do", "return", "throw", "break", "continue", "switch", "case", "default", "try", "catch", "finally", "function", "class", "import", "export", "const", "let", "var", "new", "typeof", "instanceof", "in", "of", "void", "delete", "async", "await", "yield"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
#: Binding strength of operators between two operands.
_POWER = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 3, "&": 3, "==": 4, "!=": 4, "===": 4, "!==": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "instanceof": 5, "in": 5, "as": 5, "satisfies": 5, "<<": 6, ">>": 6, ">>>": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "**": 9}


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, punct, end
    text: str
    line: int
    at: int
    broken: bool = False  # a line break stands before it
    parts: tuple = ()  # of a template: strings and token lists


class Unreadable(Exception):
    pass


def tokens(source: str, at: int = 0, line: int = 1, closing: str = "") -> tuple[list[Token], int, int]:
    """Tokens up to the end, or up to the brace that closes a template's hole; also where that is."""
    out: list[Token] = []
    depth, broken = 0, False
    while at < len(source):
        c = source[at]
        if c == "`":
            t, at, line = _template(source, at, line)
            t.broken, broken = broken, False
            out.append(t)
            continue
        last = out[-1] if out else None
        if c == "/" and not source.startswith(("//", "/*"), at) and (last is None or last.text in _BEFORE_REGEX and last.kind in ("punct", "name")) and (m := _REGEX.match(source, at)):
            out.append(Token("regex", m[0], line, at, broken))
            at, broken = m.end(), False
            continue
        m = _TOKEN.match(source, at)
        if not m:
            out.append(Token("punct", c, line, at, broken))
            at, broken = at + 1, False
            continue
        kind, text = m.lastgroup, m[0]
        if closing and kind == "punct":
            depth += (text == "{") - (text == "}")
            if depth < 0:
                return out, at, line
        if kind in ("space", "line", "comment"):
            broken = broken or "\n" in text
        else:
            out.append(Token(kind, text, line, at, broken))
            broken = False
        line += text.count("\n")
        at = m.end()
    return out, at, line


def _template(source: str, at: int, line: int) -> tuple[Token, int, int]:
    begin, first, parts, text = at, line, [], []
    at += 1
    while at < len(source) and source[at] != "`":
        if source[at] == "\\":
            text.append(source[at : at + 2])
            at += 2
        elif source.startswith("${", at):
            parts.append("".join(text))
            text = []
            inner, at, line = tokens(source, at + 2, line, "}")
            parts.append(inner)
            at += 1
        else:
            line += source[at] == "\n"
            text.append(source[at])
            at += 1
    parts.append("".join(text))
    return Token("template", source[begin : at + 1], first, begin, parts=tuple(parts)), at + 1, line


class Reader:
    def __init__(self, source: str, module: Module):
        self.source, self.module = source, module
        self.toks, _, line = tokens(source)
        self.toks.append(Token("end", "", line, len(source), True))
        self.i = 0
        self.scope: list[str] = []

    # tokens

    @property
    def now(self) -> Token:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in ("punct", "name")

    def take(self, text: str | None = None) -> Token:
        t = self.now
        if t.kind == "end" or (text is not None and t.text != text):
            raise Unreadable(f"{text} expected at line {t.line}")
        self.i += 1
        return t

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def skip_balanced(self) -> None:
        """Past a bracketed group that begins here."""
        depth = 0
        while self.now.kind != "end":
            t = self.take()
            if t.kind == "punct":
                depth += t.text in "([{"
                depth -= t.text in ")]}"
            if depth <= 0:
                return

    # types are read past

    def type_text(self, stops: tuple[str, ...] = (",", ")", "=", ";", "{", "=>")) -> str:
        begin, depth = self.now.at, 0
        first = True
        while self.now.kind != "end":
            t = self.now
            if depth == 0 and (t.text in stops or t.text in ("}", "]")) and not (first and t.text in ("{", "(")):
                break
            if depth == 0 and t.broken and not first and t.text not in ("|", "&", "."):
                break
            if t.kind == "punct":
                depth += t.text in "([{<"
                depth -= t.text in ")]}>"
            self.i += 1
            first = False
            if depth == 0 and self.at("=>") and "=>" in stops and t.text == ")":
                continue
        return self.source[begin : self.now.at].strip()

    def generics(self) -> None:
        """Past <...> before a call or parameter list, if it is one."""
        if not self.at("<"):
            return
        i, depth = self.i, 0
        while self.toks[i].kind != "end" and i < self.i + 60:
            t = self.toks[i].text
            depth += t == "<"
            depth -= t == ">"
            if depth == 0:
                if self.toks[i + 1].text == "(":
                    self.i = i + 1
                return
            if t in (";", "{", "}"):
                return
            i += 1

    # statements

    def program(self) -> list[Stmt]:
        out: list[Stmt] = []
        while self.now.kind != "end":
            out += self.safe_statement()
        return out

    def safe_statement(self) -> list[Stmt]:
        begin = self.i
        try:
            return self.statement()
        except (Unreadable, RecursionError) as e:
            self.module.errors.append((str(e) or "too deep", self.toks[begin].line))
            self.i = max(self.i, begin + 1)
            while self.now.kind != "end" and not self.at(";", "}") and not self.now.broken:
                if self.at("(", "[", "{"):
                    self.skip_balanced()
                else:
                    self.i += 1
            self.eat(";", "}")
            return []

    def block(self) -> list[Stmt]:
        self.take("{")
        out: list[Stmt] = []
        while not self.at("}"):
            if self.now.kind == "end":
                raise Unreadable("a block without end")
            out += self.safe_statement()
        self.take("}")
        return out

    def body(self) -> list[Stmt]:
        return self.block() if self.at("{") else self.statement()

    def end_statement(self) -> None:
        self.eat(";")

    def statement(self) -> list[Stmt]:
        t = self.now
        line = t.line
        done = lambda kind, **k: [Stmt(kind, line, end=self.toks[max(self.i - 1, 0)].line, **k)]
        if t.kind == "punct" and t.text == ";":
            self.i += 1
            return []
        if t.kind == "punct" and t.text == "{":
            return done("block", body=self.block())
        if t.kind == "name":
            match t.text:
                case "import" if self.peek().text not in ("(", "."):
                    return self.imports()
                case "export":
                    return self.exports()
                case "const" | "let" | "var":
                    return self.declaration()
                case "function":
                    return self.function_statement()
                case "async" if self.peek().text == "function" and not self.peek().broken:
                    self.i += 1
                    return self.function_statement()
                case "class" | "abstract" if t.text == "class" or self.peek().text == "class":
                    self.eat("abstract")
                    return self.klass()
                case "if":
                    self.i += 1
                    self.take("(")
                    test = self.expression()
                    self.take(")")
                    body = self.body()
                    self.eat(";")
                    orelse = self.body() if self.eat("else") else []
                    return done("if", value=test, body=body, orelse=orelse)
                case "while":
                    self.i += 1
                    self.take("(")
                    test = self.expression()
                    self.take(")")
                    return done("loop", value=test, body=self.body())
                case "do":
                    self.i += 1
                    body = self.body()
                    self.take("while")
                    self.take("(")
                    test = self.expression()
                    self.take(")")
                    self.end_statement()
                    return done("loop", value=test, body=body)
                case "for":
                    return self.loop()
                case "return" | "throw":
                    self.i += 1
                    value = None if self.at(";", "}") or self.now.broken or self.now.kind == "end" else self.expression()
                    self.end_statement()
                    return done("return" if t.text == "return" else "raise", value=value)
                case "break" | "continue":
                    self.i += 1
                    if self.now.kind == "name" and not self.now.broken and self.now.text not in _KEYWORDS:
                        self.i += 1
                    self.end_statement()
                    return done(t.text)
                case "switch":
                    return self.switch()
                case "try":
                    self.i += 1
                    body, handlers, final = self.block(), [], []
                    if self.eat("catch"):
                        name = ""
                        if self.eat("("):
                            name = self.now.text
                            self.i -= 1
                            self.skip_balanced()
                        handlers.append((name, self.block()))
                    if self.eat("finally"):
                        final = self.block()
                    return done("try", body=body, handlers=handlers, final=final)
                case "interface" | "declare" | "namespace" if self.peek().kind == "name" and not self.peek().broken:
                    while not self.at("{", ";") and self.now.kind != "end":
                        self.i += 1
                    if self.at("{"):
                        self.skip_balanced()
                    return done("pass")
                case "type" if self.peek().kind == "name" and self.peek(2).text in ("=", "<"):
                    while not self.eat("="):
                        self.take()
                    self.type_text((";",))
                    self.end_statement()
                    return done("pass")
                case "enum" if self.peek().kind == "name":
                    self.i += 2
                    self.skip_balanced()
                    return done("pass")
            if self.peek().text == ":" and t.text not in _KEYWORDS:  # a label
                self.i += 2
                return self.statement()
        value = self.expression()
        self.end_statement()
        if value.kind == "other" and value.name in _ASSIGN:
            return done("assign", targets=(value.parts[0],), value=self.assigned(value), augmented=value.name != "=")
        return done("expr", value=value)

    @staticmethod
    def assigned(e: Expr) -> Expr:
        if e.name == "=":
            return e.parts[1]
        return Expr("concat" if e.name == "+=" else "other", e.name, e.parts, line=e.line)

    def declaration(self) -> list[Stmt]:
        line = self.take().line
        out: list[Stmt] = []
        while True:
            target = self.pattern()
            note = self.type_text((",", "=", ";", "of", "in", ")")) if self.eat("!", ":") and (self.toks[self.i - 1].text == ":" or self.eat(":")) else ""
            value = None
            if self.eat("="):
                self.named = target.name if target.kind == "name" else ""
                value = self.assignment()
                self.named = ""
            out += self.bound(target, value, line, note)
            if not self.eat(","):
                break
        self.end_statement()
        return out

    named = ""

    def bound(self, target: Expr, value: Expr | None, line: int, note: str = "") -> list[Stmt]:
        """Assignments of a pattern's names: a destructured name reads its member."""
        end = self.toks[max(self.i - 1, 0)].line
        if target.kind == "name":
            if value is not None and value.kind == "call" and value.callee == "require" and value.args:
                self.require(value, ((("*", target.name)),))
            return [Stmt("assign", line, (target,), value, end=end, annotation=note)]
        if value is not None and value.kind == "call" and value.callee == "require":
            self.require(value, tuple((k, p.name) for k, p in zip(target.keys, target.parts, strict=False) if p.kind == "name"))
        out: list[Stmt] = []
        for k, p in enumerate(target.parts):
            member = None
            if value is not None:
                key = target.keys[k] if target.kind == "object" and k < len(target.keys) else ""
                member = Expr("attr", key, (value,), line=line) if key and key != "*" else Expr("index", "", (value, Expr("const", "int", value=k, line=line)), line=line)
            out += self.bound(p.parts[0] if p.kind == "spread" else p, member, line)
        return out

    def require(self, call: Expr, names: tuple[tuple[str, str], ...]) -> None:
        """Gives the import that the call has left its names."""
        for i, x in enumerate(self.module.imports):
            if x.kind == "require" and x.line == call.line and not x.names and x.module == call.args[0].value:
                self.module.imports[i] = Import(x.module, names, "require", x.line)
                return

    def pattern(self) -> Expr:
        t = self.now
        if t.text == "{":
            self.take("{")
            keys, parts = [], []
            while not self.eat("}"):
                if self.eat("..."):
                    keys.append("*")
                    parts.append(Expr("spread", "", (self.pattern(),), line=t.line))
                else:
                    key = self.take().text.strip("'\"")
                    if key == "[":
                        while not self.eat("]"):
                            self.take()
                        key = "*"
                    parts.append(self.pattern() if self.eat(":") else Expr("name", key, line=t.line))
                    keys.append(key)
                    if self.eat("="):
                        self.assignment()
                self.eat(",")
            return Expr("object", "", tuple(parts), tuple(keys), line=t.line)
        if t.text == "[":
            self.take("[")
            parts = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    parts.append(Expr("spread", "", (self.pattern(),), line=t.line))
                else:
                    parts.append(self.pattern())
                    if self.eat("="):
                        self.assignment()
            return Expr("list", "", tuple(parts), line=t.line)
        if t.kind != "name":
            raise Unreadable(f"a name expected at line {t.line}")
        self.i += 1
        return Expr("name", t.text, line=t.line)

    def loop(self) -> list[Stmt]:
        line = self.take("for").line
        self.eat("await")
        self.take("(")
        before: list[Stmt] = []
        if self.at("const", "let", "var"):
            i = self.i
            self.i += 1
            target = self.pattern()
            if self.eat("of", "in"):
                value = self.expression()
                self.take(")")
                return [Stmt("loop", line, (target,), value, self.body(), end=self.toks[self.i - 1].line)]
            self.i = i
            before = self.declaration()
            if self.toks[self.i - 1].text != ";":
                self.take(";")
        elif not self.eat(";"):
            value = self.expression()
            if self.eat("of", "in"):
                source = self.expression()
                self.take(")")
                return [Stmt("loop", line, (value,), source, self.body(), end=self.toks[self.i - 1].line)]
            before = [Stmt("expr", line, value=value, end=line)]
            self.take(";")
        test = None if self.at(";") else self.expression()
        self.take(";")
        step = [] if self.at(")") else [Stmt("expr", line, value=self.expression(), end=line)]
        self.take(")")
        return [*before, Stmt("loop", line, value=test, body=[*self.body(), *step], end=self.toks[self.i - 1].line)]

    def switch(self) -> list[Stmt]:
        line = self.take("switch").line
        self.take("(")
        value = self.expression()
        self.take(")")
        self.take("{")
        cases: list[tuple[Expr | None, list[Stmt], int]] = []
        while not self.eat("}"):
            at = self.now.line
            test = None
            if self.eat("case"):
                test = self.expression()
            else:
                self.take("default")
            self.take(":")
            body: list[Stmt] = []
            while not self.at("case", "default", "}"):
                if self.now.kind == "end":
                    raise Unreadable("a switch without end")
                body += [s for s in self.safe_statement() if s.kind != "break"]
            cases.append((test, body, at))
        out: list[Stmt] = []
        for test, body, at in reversed(cases):
            out = [Stmt("if", at, value=Expr("compare", "===", (value, test), line=at), body=body, orelse=out, end=self.toks[self.i - 1].line)] if test is not None else [*body, *out]
        return out or [Stmt("expr", line, value=value, end=line)]

    # functions and classes

    def params(self) -> list[Param]:
        self.take("(")
        out: list[Param] = []
        while not self.eat(")"):
            while self.at("public", "private", "protected", "readonly") and self.peek().kind == "name":
                self.i += 1
            rest = self.eat("...")
            p = self.pattern()
            self.eat("?")
            note = self.type_text((",", ")", "=")) if self.eat(":") else ""
            begin = self.now.at
            default = None
            if self.eat("="):
                self.assignment()
                default = self.source[begin + 1 : self.now.at].strip()
            names = [p.name] if p.kind == "name" else ["{" + ",".join(x.name or "*" for x in p.parts) + "}"]
            out += [Param(("..." if rest else "") + n, note, default) for n in names]
            if not self.at(")"):
                self.take(",")
        return out

    def function(self, name: str, line: int, owner: str = "", params: list[Param] | None = None, arrow: bool = False) -> None:
        """The rest of a function, from its parameters on."""
        at = len(self.module.functions)
        self.scope.append(name)
        qualified = ".".join(self.scope)
        if params is None:
            self.generics()
            params = self.params()
        returns = ""
        if not arrow and self.eat(":"):
            returns = self.type_text(("{", ";"))
        bound = [s for p in params if p.name.startswith("{") for s in self.opened(p, line)]
        if self.at("{"):
            body = self.block()
        elif arrow:
            value = self.assignment()
            body = [Stmt("return", value.line or line, value=value, end=self.toks[self.i - 1].line)]
        else:  # a declaration without a body
            self.end_statement()
            body = []
        self.scope.pop()
        self.module.functions.insert(at, Function(name, qualified, params, bound + body, line, self.toks[self.i - 1].line, [], owner, returns))

    @staticmethod
    def opened(p: Param, line: int) -> list[Stmt]:
        """A destructured parameter's names read its members."""
        whole = Expr("name", p.name, line=line)
        return [Stmt("assign", line, (Expr("name", n, line=line),), Expr("attr", n, (whole,), line=line), end=line) for n in p.name[1:-1].split(",") if n and n != "*"]

    def function_statement(self) -> list[Stmt]:
        line = self.take("function").line
        self.eat("*")
        name = self.take().text
        self.function(name, line)
        return [Stmt("def", line, (Expr("name", name, line=line),), end=self.toks[self.i - 1].line)]

    def klass(self) -> list[Stmt]:
        line = self.take("class").line
        name = self.take().text if self.now.kind == "name" and not self.at("extends") else "anonymous"
        bases: list[str] = []
        while not self.at("{"):
            if self.eat("extends", "implements", ","):
                bases.append(self.now.text)
            self.take()
        self.take("{")
        self.scope.append(name)
        body: list[Stmt] = []
        fields: list[str] = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            while self.at("static", "public", "private", "protected", "readonly", "async", "get", "set", "override", "abstract", "*", "declare") and self.peek().text not in ("(", "=", ";", ":", "}"):
                self.i += 1
            at = self.now.line
            member = self.take().text
            if member.startswith("@"):
                if self.at("("):
                    self.skip_balanced()
                continue
            if member == "[":
                self.i -= 1
                self.skip_balanced()
                member = "[]"
            self.eat("?", "!")
            if self.at("(", "<"):
                self.function(member, at, name)
            else:
                note = self.type_text(("=", ";")) if self.eat(":") else ""
                value = None
                if self.eat("="):
                    self.named = member
                    value = self.assignment()
                    self.named = ""
                self.end_statement()
                fields.append(member)
                body.append(Stmt("assign", at, (Expr("attr", member, (Expr("name", "this", line=at),), line=at),), value, end=at, annotation=note))
        self.scope.pop()
        self.module.classes.append(Class(name, line, self.toks[self.i - 1].line, tuple(bases), tuple(fields)))
        return [Stmt("def", line, (Expr("name", name, line=line),), body=body, end=self.toks[self.i - 1].line)]

    # modules

    def imports(self) -> list[Stmt]:
        line = self.take("import").line
        names: list[tuple[str, str]] = []
        if self.now.kind != "string":
            if self.at("type") and self.peek().text != "from":
                self.i += 1
            while not self.eat("from"):
                if self.eat("*"):
                    self.take("as")
                    names.append(("*", self.take().text))
                elif self.eat("{"):
                    names += self.specifiers()
                elif not self.eat(","):
                    names.append(("default", self.take().text))
        module = self.take()
        if module.kind != "string":
            raise Unreadable(f"a module expected at line {line}")
        self.module.imports.append(Import(module.text[1:-1], tuple(names), "static", line))
        if self.eat("with", "assert"):
            self.skip_balanced()
        self.end_statement()
        return [Stmt("pass", line, end=line)]

    def specifiers(self) -> list[tuple[str, str]]:
        out = []
        while not self.eat("}"):
            if self.at("type") and self.peek().text not in (",", "}", "as"):
                self.i += 1
            a = self.take().text.strip("'\"")
            out.append((a, self.take().text if self.eat("as") else a))
            self.eat(",")
        return out

    def exports(self) -> list[Stmt]:
        line = self.take("export").line
        add = lambda name, kind: self.module.exports.append((name, kind, line))
        if self.eat("*"):
            name = self.take().text if self.eat("as") else "*"
            self.take("from")
            self.module.imports.append(Import(self.take().text[1:-1], ((name, name),), "export", line))
            self.end_statement()
            return []
        if self.at("{"):
            self.take("{")
            names = self.specifiers()
            for _, name in names:
                add(name, "default" if name == "default" else "name")
            if self.eat("from"):
                self.module.imports.append(Import(self.take().text[1:-1], tuple(names), "export", line))
            self.end_statement()
            return []
        if self.eat("default"):
            i = self.i
            if self.at("function", "class") or (self.at("async") and self.peek().text == "function"):
                self.eat("async")
                kind = self.now.text
                named = self.peek(2 if self.peek().text == "*" else 1)
                name = named.text if named.kind == "name" and named.text != "extends" else "default"
                add(name, "default")
                if name == "default" and kind == "function":
                    self.take("function")
                    self.eat("*")
                    self.function("default", line)
                    return [Stmt("def", line, end=self.toks[self.i - 1].line)]
                return self.statement()
            self.i = i
            self.named = "default"
            value = self.assignment()
            self.named = ""
            add(value.name if value.kind == "name" else "default", "default")
            self.end_statement()
            return [Stmt("expr", line, value=value, end=self.toks[self.i - 1].line)]
        first = self.now.text if self.now.text != "async" else "function"
        out = self.statement()
        for s in out:
            if s.kind in ("assign", "def"):
                for t in s.targets:
                    if t.kind == "name":
                        add(t.name, "class" if first in ("class", "abstract") else "function" if s.kind == "def" or (s.value is not None and s.value.kind == "function") else "name")
        return out

    # expressions

    def expression(self) -> Expr:
        first = self.assignment()
        while self.eat(","):
            first = Expr("other", ",", (first, self.assignment()), line=first.line)
        return first

    def arrow_ahead(self) -> bool:
        """Whether the group that begins here is the parameter list of an arrow function."""
        i, depth = self.i, 0
        while self.toks[i].kind != "end":
            t = self.toks[i]
            if t.kind == "punct":
                depth += t.text in "([{"
                depth -= t.text in ")]}"
            i += 1
            if depth == 0:
                break
        if self.toks[i].text == "=>":
            return True
        if self.toks[i].text == ":":  # a type of the result, on one line
            line = self.toks[i].line
            while self.toks[i].kind != "end" and self.toks[i].line == line and self.toks[i].text not in (";", ",", "?", "{"):
                if self.toks[i].text == "=>":
                    return True
                i += 1
        return False

    def arrow(self, params: list[Param], line: int) -> Expr:
        name, self.named = self.named or "anonymous", ""
        if self.eat(":"):
            self.type_text(("=>",))
        self.take("=>")
        self.function(name, line, params=params, arrow=True)
        return Expr("function", ".".join([*self.scope, name]), line=line)

    def assignment(self) -> Expr:
        t = self.now
        if t.text == "async" and not self.peek().broken and (self.peek().text == "(" or self.peek(2).text == "=>") and self.peek().text != "function":
            i = self.i
            self.i += 1
            if self.now.kind == "name" or self.arrow_ahead():
                return self.assignment()
            self.i = i
        if t.kind == "name" and self.peek().text == "=>" and t.text not in _KEYWORDS:
            self.i += 1
            return self.arrow([Param(t.text)], t.line)
        if t.text == "(" and t.kind == "punct" and self.arrow_ahead():
            return self.arrow(self.params(), t.line)
        if t.text == "yield" and t.kind == "name":
            self.i += 1
            self.eat("*")
            return Expr("other", "yield", () if self.at(")", "]", "}", ",", ";") or self.now.broken else (self.assignment(),), line=t.line)
        left = self.choice()
        if self.now.kind == "punct" and self.now.text in _ASSIGN:
            op = self.take().text
            self.named = left.name if left.kind in ("name", "attr") and op == "=" else ""
            right = self.assignment()
            self.named = ""
            return Expr("other", op, (left, right), line=t.line)
        return left

    def choice(self) -> Expr:
        test = self.binary(0)
        if self.at("?") and self.now.kind == "punct":
            self.take("?")
            a = self.assignment()
            self.take(":")
            return Expr("other", "choice", (test, a, self.assignment()), line=test.line)
        return test

    def binary(self, least: int) -> Expr:
        left = self.unary()
        while True:
            t = self.now
            text, width = t.text, 1
            if text == ">" and t.kind == "punct":  # >>, >>> and >= come as single signs
                while width < 3 and self.peek(width).text == ">" and self.peek(width).at == t.at + width:
                    width += 1
                if self.peek(width).text == "=" and self.peek(width).at == t.at + width:
                    width += 1
                text = ">" if width == 1 else ">=" if width == 2 and self.peek().text == "=" else ">>"
            power = _POWER.get(text, -1) if t.kind in ("punct", "name") else -1
            if power < 0 or power <= least or (t.broken and text in ("as", "satisfies")):
                return left
            self.i += width
            if text in ("as", "satisfies"):
                self.type_text((",", ")", ";", "=", "]", "}", ":", "?", "&&", "||", "."))
                continue
            right = self.binary(power)
            if text in ("&&", "||", "??"):
                left = Expr("and" if text == "&&" else "or", "", (left, right), line=t.line)
            elif power in (4, 5):
                left = Expr("compare", text, (left, right), line=t.line)
            else:
                left = Expr("concat" if text == "+" else "other", text, (left, right), line=t.line)

    def unary(self) -> Expr:
        t = self.now
        if t.kind == "punct" and t.text in ("!", "-", "+", "~", "++", "--"):
            self.i += 1
            x = self.unary()
            return Expr("not" if t.text == "!" else "other", "" if t.text == "!" else t.text, (x,), line=t.line)
        if t.kind == "name" and t.text in ("typeof", "void", "delete", "await"):
            self.i += 1
            x = self.unary()
            return x if t.text == "await" else Expr("other", t.text, (x,), line=t.line)
        x = self.postfix(self.primary())
        if self.at("++", "--") and not self.now.broken:
            self.i += 1
            x = Expr("other", "++", (x,), line=t.line)
        return x

    def arguments(self) -> tuple[Expr, ...]:
        self.take("(")
        out = []
        while not self.eat(")"):
            out.append(Expr("spread", "", (self.assignment(),), line=self.now.line) if self.eat("...") else self.assignment())
            if not self.at(")"):
                self.take(",")
        return tuple(out)

    def postfix(self, x: Expr) -> Expr:
        while True:
            t = self.now
            if t.kind == "template":
                self.i += 1
                x = Expr("call", "", (x, self.template(t)), line=t.line)
            elif t.kind != "punct":
                return x
            elif t.text in (".", "?."):
                self.i += 1
                if self.at("("):
                    x = Expr("call", "", (x, *self.arguments()), line=t.line)
                elif self.at("["):
                    continue
                else:
                    x = Expr("attr", self.take().text, (x,), line=t.line)
            elif t.text == "[":
                self.i += 1
                x = Expr("index", "", (x, self.expression()), line=t.line)
                self.take("]")
            elif t.text == "(":
                x = Expr("call", "", (x, *self.arguments()), line=t.line)
                self.called(x)
            elif t.text == "!" and not t.broken and self.peek().text in (".", ")", ";", ",", "["):
                self.i += 1
            elif t.text == "<":
                i = self.i
                self.generics()
                if self.i == i:
                    return x
            else:
                return x

    def called(self, x: Expr) -> None:
        if x.callee in ("require", "import") and x.args and isinstance(x.args[0].value, str):
            self.module.imports.append(Import(x.args[0].value, (), "require" if x.callee == "require" else "dynamic", x.line))

    def template(self, t: Token) -> Expr:
        parts: list[Expr] = []
        for p in t.parts:
            if isinstance(p, str):
                if p:
                    parts.append(Expr("const", "str", value=p, line=t.line))
            else:
                held, at = self.toks, self.i
                self.toks, self.i = [*p, Token("end", "", t.line, len(self.source), True)], 0
                try:
                    parts.append(self.expression() if p else Expr("const", "str", value="", line=t.line))
                finally:
                    self.toks, self.i = held, at
        return parts[0] if len(parts) == 1 and parts[0].kind == "const" else Expr("concat", "template", tuple(parts), line=t.line)

    def primary(self) -> Expr:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return Expr("const", "number", value=t.text, line=t.line)
        if t.kind == "string":
            self.i += 1
            return Expr("const", "str", value=t.text[1:-1], line=t.line)
        if t.kind == "regex":
            self.i += 1
            return Expr("const", "regex", value=t.text, line=t.line)
        if t.kind == "template":
            self.i += 1
            return self.template(t)
        if t.text == "(":
            self.i += 1
            x = self.expression()
            self.take(")")
            return x
        if t.text == "[":
            self.i += 1
            parts = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                parts.append(Expr("spread", "", (self.assignment(),), line=t.line) if self.eat("...") else self.assignment())
            return Expr("list", "array", tuple(parts), line=t.line)
        if t.text == "{":
            return self.object()
        if t.text == "<" and (self.peek().kind == "name" or self.peek().text == ">"):
            return self.markup()
        if t.kind == "name":
            if t.text == "function" or (t.text == "async" and self.peek().text == "function"):
                self.eat("async")
                self.take("function")
                self.eat("*")
                name = self.take().text if self.now.kind == "name" else self.named or "anonymous"
                self.named = ""
                self.function(name, t.line)
                return Expr("function", ".".join([*self.scope, name]), line=t.line)
            if t.text == "class":
                self.klass()
                return Expr("function", "class", line=t.line)
            if t.text == "new":
                self.i += 1
                callee = self.primary()
                while self.at(".", "["):
                    if self.eat("."):
                        callee = Expr("attr", self.take().text, (callee,), line=t.line)
                    else:
                        self.skip_balanced()
                self.generics()
                return Expr("new", "", (callee, *(self.arguments() if self.at("(") else ())), line=t.line)
            if t.text in ("true", "false", "null", "undefined"):
                self.i += 1
                return Expr("const", {"true": "bool", "false": "bool", "null": "NoneType", "undefined": "NoneType"}[t.text], value={"true": True, "false": False}.get(t.text), line=t.line)
            if t.text in _KEYWORDS - {"async", "of", "import"}:
                raise Unreadable(f"{t.text} at line {t.line}")
            self.i += 1
            return Expr("name", t.text, line=t.line)
        raise Unreadable(f"{t.text or 'the end'} at line {t.line}")

    def object(self) -> Expr:
        line = self.take("{").line
        keys, parts = [], []
        while not self.eat("}"):
            if self.eat("..."):
                keys.append("*")
                parts.append(Expr("spread", "", (self.assignment(),), line=line))
            else:
                while self.at("async", "get", "set", "*") and self.peek().text not in (":", ",", "}", "("):
                    self.i += 1
                t = self.take()
                key = t.text.strip("'\"")
                if t.text == "[":
                    self.expression()
                    self.take("]")
                    key = "*"
                if self.at("(", "<"):
                    self.function(key, t.line)
                    parts.append(Expr("function", ".".join([*self.scope, key]), line=t.line))
                elif self.eat(":"):
                    self.named = key
                    parts.append(self.assignment())
                    self.named = ""
                else:
                    parts.append(Expr("name", key, line=t.line))
                    if self.eat("="):
                        self.assignment()
                keys.append(key)
            if not self.at("}"):
                self.take(",")
        return Expr("object", "object", tuple(parts), tuple(keys), line=line)

    def markup(self) -> Expr:
        """A JSX element: its attributes and the expressions in braces."""
        line = self.take("<").line
        tag = ""
        while self.now.kind == "name" or self.at(".", ":", "-"):
            if self.now.kind == "name" and tag and tag[-1] not in ".:-":
                break
            tag += self.take().text
        parts: list[Expr] = []
        while not self.at(">", "/"):
            if self.eat("{"):
                self.take("...")
                parts.append(self.assignment())
                self.take("}")
                continue
            at = self.now.line
            name = self.take().text
            while self.at("-", ":"):
                name += self.take().text
                name += self.take().text
            value = Expr("const", "bool", value=True, line=at)
            if self.eat("="):
                if self.eat("{"):
                    value = self.expression()
                    self.take("}")
                elif self.now.kind == "string":
                    value = self.primary()
                else:
                    value = self.markup()
            self.module.attributes.append((name, value, at))
            parts.append(value)
        if self.eat("/"):
            self.take(">")
            return Expr("other", "jsx", tuple(parts), line=line)
        self.take(">")
        while True:
            self.text_of_markup()
            if self.now.kind == "end":
                raise Unreadable("markup without end")
            if self.at("<"):
                if self.peek().text == "/":
                    while not self.eat(">"):
                        self.take()
                    return Expr("other", "jsx", tuple(parts), line=line)
                parts.append(self.markup())
            else:
                self.take("{")
                if not self.at("}"):
                    parts.append(self.expression())
                self.take("}")

    def text_of_markup(self) -> None:
        """Past the text up to the next tag or brace; quotes in it are no strings, so what follows is read anew."""
        last = self.toks[self.i - 1]
        begin = last.at + len(last.text)
        ends = [k for k in (self.source.find("<", begin), self.source.find("{", begin)) if k >= 0]
        end = min(ends, default=len(self.source))
        text = self.source[begin:end]
        if any(c in text for c in "'\"`/"):
            rest, _, line = tokens(self.source, end, last.line + text.count("\n"))
            self.toks[self.i :] = [*rest, Token("end", "", line, len(self.source), True)]
        while self.now.kind != "end" and self.now.at < end:
            self.i += 1


def read(source: str, language: str = "javascript") -> Module:
    module = Module(language)
    reader = Reader(source, module)
    try:
        module.body = reader.program()
    except RecursionError:
        module.errors.append(("too deep", 1))
    # attributes that are set by a call: React.createElement(tag, {name: value})
    for body in [module.body, *[f.body for f in module.functions]]:
        for e in expressions(body):
            if e.kind == "call" and e.callee.split(".")[-1] == "createElement" and len(e.args) > 1 and e.args[1].kind == "object":
                module.attributes += [(k, v, v.line or e.line) for k, v in zip(e.args[1].keys, e.args[1].parts, strict=True)]
    module.imports.sort(key=lambda i: i.line)
    return module
