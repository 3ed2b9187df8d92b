"""Scopes of Go, Java, JavaScript and TypeScript files and what happens in them, as a table.

A file is read once: strings and comments are blanked, braces are paired, and each opening brace is
told apart by what stands before it (function, loop, test, class, lock, goroutine ...). Definitions,
uses, calls and the scopes themselves become rows that carry where they stand: the function, class,
loop and goroutine around them and the labels of all scopes that are open there. Checks are then
filters, windows and joins on this table (``scope_checks``).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: A row for each fact. ``scope_end``: where the scope around it closes; ``inside``: labels of the open scopes, outermost first.
COLUMNS = [
    ("kind", pa.string()), ("name", pa.string()), ("base", pa.string()), ("arg", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("at", pa.int64()),
    ("scope", pa.int64()), ("scope_end", pa.int64()), ("fn", pa.int64()), ("fn_name", pa.string()), ("fn_head", pa.string()), ("fn_line", pa.int64()),
    ("loop", pa.int64()), ("loop_line", pa.int64()), ("cls", pa.int64()), ("go", pa.int64()), ("go_line", pa.int64()), ("inside", pa.list_(pa.string())),
]
SCHEMA = "kind string, name string, base string, arg string, line_start long, line_end long, at long, scope long, scope_end long, fn long, fn_name string, fn_head string, fn_line long, loop long, loop_line long, cls long, go long, go_line long, inside array<string>"

_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_MASKS = {
    "go": regex.compile(rf"{_COMMENT}|(?P<text>`[^`]*`?|{_QUOTED})", regex.S),
    "java": regex.compile(rf'{_COMMENT}|(?P<text>""".*?(?:"""|\Z)|{_QUOTED})', regex.S),
    "javascript": regex.compile(rf"{_COMMENT}|(?P<template>`(?:\\.|[^`\\])*`?)|(?P<text>{_QUOTED})|(?<=[=(,:\[!&|?{{}};]\s*)(?P<pattern>/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/)", regex.S),
}
_MASKS["typescript"] = _MASKS["javascript"]
_KEPT = regex.compile(r"\$\{([^{}]*)\}")
_SEEN = regex.compile(r"[^\n]")

_NAME = r"[A-Za-z_$][\w$]*"
_CALL = rf"(?P<call>{_NAME}(?:\s*\.\s*{_NAME})*)(?=\s*\()"
_MEMBER = rf"(?P<member>{_NAME}(?:\.{_NAME})+)"
_MARKS = r"(?P<open>\{)|(?P<close>\})|(?P<paren>[()])|(?P<end>;)|(?P<line>\n)"
_TYPE = r"(?:[A-Z]\w*(?:\s*\.\s*[A-Z]\w*)*(?:\s*<[^;{}()=]*>)?|int|long|boolean|double|float|char|byte|short)(?:\s*\[\s*\])*"
#: What the walk over a blanked file stops at, and the names whose uses count (those it declares, and the words after them).
_TOKENS = {
    "go": regex.compile(
        rf"{_MARKS}|(?P<define>\w+(?:\s*,\s*\w+)*)(?=\s*:=)|\bvar\s+(?P<var>\w+)|(?P<nil>\w+)(?=\s*[!=]=\s*nil\b)|(?P<go>\bgo)(?=\s+(?:func\b|[\w.]+\s*\())|(?P<defer>\bdefer\b)"
        rf"|(?<![\w\])]\s*)<-\s*(?P<receive>\w[\w.]*)|\breturn\s+(?P<give>err)\b|(?P<drop>\b_)(?=\s*=\s*\w[\w.]*\()|{_CALL}|{_MEMBER}|(?P<word>{_NAME})"),
    "java": regex.compile(
        rf"{_MARKS}|(?P<declare>(?:\b(?:private|protected|public|static|final|volatile|transient)\s+)*+\b{_TYPE}\s+\w+)(?=\s*(?:=(?!=)|;))|(?P<set>\w+)(?=\s*(?:\+\+|--|(?:[-+*/%&|^]|<<|>>)?=(?!=)))|(?:\+\+|--)\s*(?P<step>\w+)"
        rf"|\breturn\s+(?P<give>null)\s*(?=;)|{_CALL}|{_MEMBER}|(?P<word>{_NAME})"),
    "javascript": regex.compile(rf"{_MARKS}|\b(?:const|let|var)\s+(?P<declare>{_NAME})(?=\s*=(?![=>]))|{_CALL}|{_MEMBER}|(?P<word>{_NAME})"),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_DECLARED = {
    "go": regex.compile(r"\bvar\s+(\w+)"),
    "java": regex.compile(r"(?!)()"),
    "javascript": regex.compile(rf"\b(?:const|let|var)\s+({_NAME})\s*="),
}
_DECLARED["typescript"] = _DECLARED["javascript"]
_WORDS = {"go": {"semaphore"}, "java": {"Thread", "Runnable", "ExecutorService"}, "javascript": {"cleanup"}, "typescript": {"cleanup"}}
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "func", "function", "select", "synchronized", "go", "defer", "new", "await", "typeof", "else", "do", "try"}

_KEYS = regex.compile(r"(?P<paren>[()])|(?P<arrow>=>|->)|\b(?P<key>func|function|for|while|do|if|else|switch|select|try|catch|finally|synchronized|class|interface|enum|record|struct|new)\b")
_NULL = regex.compile(r"(\w+)\s*==\s*null\b")
_GET = regex.compile(r"\b(\w+)\.get\(\)")
#: Callbacks that run once for each element.
_EACH = regex.compile(r"\.(?:forEach|map|filter)\s*$")
_KIND = {"for": "loop", "while": "loop", "do": "loop", "else": "else", "interface": "class", "enum": "class", "record": "class", "synchronized": "sync", "struct": "type"}


def blank(text: str, language: str) -> str:
    """``text`` with spaces for comments and for what stands between quotes; expressions in templates stay, and so do all places and lines."""

    def spaces(m) -> str:
        s = m[0]
        if m["comment"] is not None:
            return _SEEN.sub(" ", s)
        quote, out, at = s[0], [s[0]], 1
        end = len(s) - (len(s) > 1 and s.endswith(quote))  # it may be open at the end of a line or of the file
        if m.lastgroup == "template":
            for k in _KEPT.finditer(s, 1, end):
                out += [_SEEN.sub(" ", s[at : k.start(1)]), k[1]]
                at = k.end(1)
        return "".join([*out, _SEEN.sub(" ", s[at:end]), s[end:]])

    return _MASKS[language].sub(spaces, text)


def _matching(text: str, at: int) -> int:
    """Where the parenthesis that opens at ``at`` closes, or the end."""
    depth = 0
    for m in regex.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.start()
    return len(text)


@dataclass
class Scope:
    id: int
    kind: str
    name: str
    head: str
    start: int
    line: int
    labels: list[str]
    fn: Scope | None = None
    loop: Scope | None = None
    cls: Scope | None = None
    go: Scope | None = None
    end: int = -1
    open_parens: int = 0
    inside: list[str] = field(default_factory=list)


def _classify(head: str, language: str, around: str) -> tuple[str, str, list[str], int]:
    """Kind, name and further labels of the scope that the statement ``head`` opens, and where in it the scope begins."""
    key, key_at, depth, callee = "", 0, 0, ""
    for m in reversed(list(_KEYS.finditer(head))):
        if m["paren"]:
            if m[0] == ")":
                depth += 1
            elif depth:
                depth -= 1
            else:
                callee = head[: m.start()]
                break
        elif not depth and (not key or m["key"] in ("class", "interface", "enum", "record")):
            key, key_at = m["key"] or "arrow", m.start()
    before = head[:key_at]
    if language == "go":
        if key == "func":
            if named := regex.match(r"func\s*(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(", head[key_at:]):
                return "function", named[1], [], key_at
            if m := regex.search(r"\b(go|defer)\s*$", before):
                return m[1], "", [], key_at
            return "closure", "", [], key_at
    elif key in ("function", "arrow"):
        each = ["loop"] if _EACH.search(callee) else []
        if language != "java":
            own = regex.match(r"function\s*\*?\s*([\w$]+)", head[key_at:]) or regex.search(rf"({_NAME})\s*[=:]\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})?\s*$", before)
            if own and not callee:
                return "function", own[1], [], key_at
        return "closure", "", each, key_at
    if key in ("class", "interface", "enum", "record", "struct") or key == "new" and language == "java":
        named = regex.match(r"\w+\s+(\w+)", head[key_at:])
        return _KIND.get(key, "class"), named[1] if named and key != "new" else "", [], key_at
    if key in ("for", "while", "do"):
        return "loop", key, ["while"] if key != "for" else [], key_at
    if key == "synchronized" and regex.match(r"synchronized\s*\(", head[key_at:]):
        return "sync", "", [], key_at
    if key in ("if", "else") and (m := regex.search(r"\bif\b(.*)", head, regex.S)):
        return "if", "", [f"null:{x}" for x in _NULL.findall(m[1])] + [f"get:{x}" for x in _GET.findall(m[1])], m.start()
    if key == "try":
        return "try", "", ["resources"] if regex.match(r"try\s*\(", head[key_at:]) else [], key_at
    if key and key != "synchronized" and key != "new":
        return _KIND.get(key, key), "", [], key_at
    if language != "go" and around in ("class", "block", "") and (m := regex.search(rf"({_NAME})\s*(?:<[^()]*>\s*)?\([^{{}}]*\)\s*(?:throws\s[\w\s.,]*|:[^{{}}()]*)?$", head)):
        if m[1] not in _NO_CALL:
            return "function", m[1], [], m.start()
    return "block", "", [], key_at


def facts(text: str, language: str) -> Iterator[tuple]:
    """Rows of COLUMNS for one file."""
    code = blank(text, language)
    lines = [m.start() for m in regex.finditer("\n", code)]
    tracked = set(_DECLARED[language].findall(code)) | _WORDS[language]
    top = Scope(0, "file", "", "", 0, 0, [])
    stack, made, rows, begin, parens = [top], 1, [], 0, 0

    def line(at: int) -> int:
        return bisect.bisect_left(lines, at) + 1

    def row(kind: str, name: str, at: int, arg: str = "", of: Scope | None = None, opened: Scope | None = None) -> None:
        rows.append((kind, name, name.partition(".")[0], arg, at, of or stack[-1], opened))

    for m in _TOKENS[language].finditer(code):
        kind, at = m.lastgroup, m.start(m.lastgroup)
        value = m[kind]
        if kind == "open":
            head = code[begin:at].lstrip()
            outer = stack[-1]
            what, name, labels, offset = _classify(head, language, outer.kind)
            s = Scope(made, what, name, (head if language == "java" else head[offset:]).strip(), at, line(at - len(head) + offset), [what, *labels], open_parens=parens)
            made += 1
            s.fn = s if what == "function" else None if what == "class" else outer.fn
            s.loop = s if "loop" in s.labels else None if what in ("function", "class") else outer.loop
            s.cls = s if what == "class" else outer.cls
            s.go = s if what == "go" else outer.go
            s.inside = ([] if what in ("function", "class") else outer.inside) + s.labels
            if what == "if":  # called by what it tests first
                name = next((x.partition(":")[2] for x in labels if x.startswith("null:")), "")
            if what not in ("block", "else"):
                row(what, name, at, s.head, s if what in ("function", "class", "go") else outer, s)
            stack.append(s)
            begin, parens = at + 1, 0
        elif kind == "close":
            if len(stack) > 1:
                s = stack.pop()
                s.end = at
                parens = s.open_parens
            begin = at + 1 if not parens else begin
        elif kind == "paren":
            parens = max(0, parens + (1 if value == "(" else -1))
        elif kind == "end" or kind == "line":
            if not parens and (kind == "end" or language == "go"):
                begin = at + 1
        elif kind == "call":
            name = regex.sub(r"\s", "", value)
            if name not in _NO_CALL and not regex.search(r"\bfunc(?:tion)?\s*$", code[max(0, at - 12) : at]):
                opens = code.index("(", m.end())
                row("call", name, at, code[opens + 1 : min(_matching(code[: opens + 400], opens), opens + 200)].strip())
                if name.partition(".")[0] in tracked:
                    row("use", name.partition(".")[0], at)
        elif kind == "member":
            row("member", value, at)
            if value.partition(".")[0] in tracked:
                row("use", value.partition(".")[0], at)
        elif kind == "word":
            if value in tracked:
                row("use", value, at)
        elif kind == "define":
            rest = code[m.end() : (code.find("\n", m.end()) + 1 or len(code) + 1) - 1].partition(":=")[2].strip()
            start = code.rfind("\n", 0, at) + 1
            tested = regex.search(r"\b(?:if|for|switch)\s+$", code[start:at])
            for name in regex.findall(r"\w+", value):
                row("test" if tested else "define", name, at, rest)
        elif kind == "declare" and language == "java":
            *_, name = value.split()
            rest = code[m.end() : m.end() + 120].partition(";")[0].strip()
            row("field" if stack[-1].kind == "class" else "local", name, at, f"{value} {rest}")
        else:
            arg = regex.match(r"\s*(\S+)", code[m.end() : m.end() + 40])
            kind = {"step": "set"}.get(kind, kind)
            if kind == "var":
                arg = regex.match(r"\s*([^\n=]*)", code[m.end() :])
            row(kind, value, at, arg[1] if arg else "")
    for s in stack:
        s.end = len(code)
    for kind, name, base, arg, at, s, opened in rows:
        first = opened.line if opened else line(at)
        fn, loop, cls, go = s.fn, s.loop, s.cls, s.go
        yield (
            kind, name, base, arg[:400], first, line(opened.end) if opened else first, at, s.id, s.end, fn.id if fn else -1, fn.name if fn else None, fn.head if fn else None, fn.line if fn else None,
            loop.id if loop else -1, loop.line if loop else None, cls.id if cls else -1, go.id if go else -1, go.line if go else None, s.inside,
        )


def scope_facts(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key``, language and COLUMNS: the facts of every Go, Java, JavaScript and TypeScript file; other languages and null texts have none.

    Files are read where they lie, one at a time; a file's braces need not match: what is open at its end closes there.
    """
    own = files.where(files["language"].isin(*_TOKENS)).select(key, "language", text)
    kinds = {f.name: f.dataType for f in own.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([b.schema.field(0), b.schema.field(1), *(pa.field(n, t) for n, t in COLUMNS)])
            for k, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(k, lang, *f) for f in facts(t or "", lang)]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return own.mapInArrow(run, f"`{key}` {kinds[key].simpleString()}, language string, {SCHEMA}")
