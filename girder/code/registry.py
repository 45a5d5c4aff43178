"""Sources, sinks and sanitizers by language, and how names meet them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Categories of sinks.
SQL, COMMAND, DOM, EVAL = "SQL", "COMMAND", "DOM", "EVAL"
EVERY = frozenset((SQL, COMMAND, DOM, EVAL))

#: Sources as (language, kind, base object, member); calls have to be called.
SOURCES = (
    *(("python", "member", "request", m) for m in ("args", "values", "form", "GET", "POST", "COOKIES", "json", "data")),
    ("python", "call", "request", "get_json"),
    ("python", "member", "os", "environ"),
    ("python", "call", "os", "getenv"),
    ("python", "member", "sys", "argv"),
    ("python", "call", "", "input"),
    *(("javascript", "member", "location", m) for m in ("search", "hash", "href", "pathname")),
    ("javascript", "member", "document", "cookie"),
    *(("javascript", "member", "req", m) for m in ("query", "params", "body", "headers")),
)
#: Sinks as (language, callee, part of the receiver, category, argument).
SINKS = (
    *(("python", c, r, SQL, 0) for c in ("execute", "executemany") for r in ("cursor", "connection", "engine", "session", "db", "conn", "")),
    ("python", "raw", "", SQL, 0),
    *(("python", c, "subprocess", COMMAND, 0) for c in ("run", "Popen", "call", "check_output", "check_call")),
    *(("python", c, "os", COMMAND, 0) for c in ("system", "popen")),
    ("python", "eval", "", EVAL, 0),
    ("python", "exec", "", EVAL, 0),
    ("javascript", "write", "document", DOM, 0),
    ("javascript", "writeln", "document", DOM, 0),
    ("javascript", "innerHTML", "", DOM, 0),
    ("javascript", "outerHTML", "", DOM, 0),
    ("javascript", "eval", "", EVAL, 0),
    ("javascript", "Function", "", EVAL, 0),
)
#: Sanitizers as (language, name, categories that they make safe).
SANITIZERS = (
    ("python", "int", (SQL, COMMAND, EVAL, DOM)),
    ("python", "float", (SQL, COMMAND, EVAL, DOM)),
    ("python", "shlex.quote", (COMMAND,)),
    ("python", "html.escape", (DOM,)),
    ("javascript", "DOMPurify.sanitize", (DOM,)),
    ("javascript", "encodeURIComponent", (DOM,)),
    ("javascript", "parseInt", (DOM, EVAL)),
    ("javascript", "parseFloat", (DOM, EVAL)),
    ("javascript", "Number", (DOM, EVAL)),
)


def family(language: str) -> str:
    return "javascript" if language in ("javascript", "typescript", "js", "jsx", "ts", "tsx") else language


def _by_last(rows: Iterable[tuple], name: Callable[[tuple], str]) -> dict[tuple[str, str], list[tuple]]:
    """Rows by their language and the last part of their name, in order: only those can match a name that ends in that part."""
    out: dict[tuple[str, str], list[tuple]] = {}
    for r in rows:
        out.setdefault((r[0], name(r).rsplit(".", 1)[-1]), []).append(r)
    return out


_SOURCES = _by_last(SOURCES, lambda r: r[3].lower())
_SINKS = _by_last(SINKS, lambda r: r[1])
_SANITIZERS = _by_last(((lang, s, frozenset(c)) for lang, s, c in SANITIZERS), lambda r: r[1])


def source_of(language: str, name: str, called: bool) -> str | None:
    """The source that a dotted name is, without regard to case."""
    low = name.lower()
    for _, kind, base, member in _SOURCES.get((family(language), low.rsplit(".", 1)[-1]), ()):
        parts = low.split(".")
        if called == (kind == "call") and (not base and len(parts) == 1 or base and len(parts) > 1 and parts[-2] == base.lower()):
            return f"{base}.{member}".lstrip(".")
    return None


def sink_of(language: str, name: str) -> tuple[str, str, int] | None:
    """(callee, category, argument) of the first sink whose callee equals the last part and whose object is in the receiver."""
    receiver, _, callee = name.rpartition(".")
    for _, c, base, category, arg in _SINKS.get((family(language), callee), ()):
        if not base or base in receiver:
            return c, category, arg
    return None


def sanitizer_of(language: str, name: str) -> tuple[str, frozenset[str]] | None:
    """A sanitizer matches by its name, or where one of both names is the other's dotted end."""
    for _, s, categories in _SANITIZERS.get((family(language), name.rsplit(".", 1)[-1]), ()):
        if name and (name == s or name.endswith("." + s) or s.endswith("." + name)):
            return s, categories
    return None
