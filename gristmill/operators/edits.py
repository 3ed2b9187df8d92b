"""Fixes as edits of a text's spans, found on syntax: Python by its tree, JavaScript on text without strings and comments.

``propose_edits`` gives rows, one for each edit; edits of one fix have its number and go together.
``apply_edits`` keeps of overlapping fixes the surest, puts the edits in and accepts a fix only if the text still
parses. Lines without an edit stay as they are, to the letter.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import resolve_conflicts
from .scopes import blank

COLUMNS = "fix long, kind string, start long, end long, new_text string, line_start long, line_end long, category string, confidence double, safe boolean, description string"
# Category, confidence, whether a fix is safe, and what it does.
KINDS = {
    "unused-import": ("imports", 0.95, True, "Remove unused import"),
    "none-comparison": ("correctness", 0.95, True, "Use identity comparison"),
    "bare-except": ("correctness", 0.9, True, "Replace bare except with except Exception"),
    "mutable-default": ("correctness", 0.7, False, "Replace mutable default argument with None"),
    "f-string": ("style", 0.85, True, "Use an f-string"),
    "concatenation": ("style", 0.7, False, "Use an f-string for concatenation"),
    "var": ("style", 0.85, True, "Replace var"),
    "equality": ("correctness", 0.9, True, "Use strict equality"),
    "template": ("style", 0.85, True, "Use a template literal"),
    "arrow": ("style", 0.75, False, "Use an arrow function"),
    "optional-chaining": ("style", 0.85, True, "Use optional chaining"),
    "nullish": ("correctness", 0.7, False, "Use ?? for defaults"),
}
Edit = tuple[int, int, str]


class _Places:
    """Offsets in a text of the tree's lines and byte columns."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def at(self, line: int, column: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode()))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


def _imports(tree: ast.Module, text: str, p: _Places) -> Iterator[tuple[str, list[Edit]]]:
    used = {x.id for x in ast.walk(tree) if isinstance(x, ast.Name)} | {x.value.partition(".")[0] for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, str)}
    for block in (x for x in ast.walk(tree) if hasattr(x, "body") and isinstance(x.body, list)):
        for body in (getattr(block, f, None) for f in ("body", "orelse", "finalbody")):
            for s in body if isinstance(body, list) else ():
                if not isinstance(s, (ast.Import, ast.ImportFrom)) or getattr(s, "module", "") == "__future__" or any(a.name == "*" for a in s.names):
                    continue
                kept = [a for a in s.names if (a.asname or a.name.partition(".")[0]) in used]
                if len(kept) == len(s.names):
                    continue
                start, end = p.span(s)
                if kept:
                    yield "unused-import", [(start, end, ast.unparse(ast.ImportFrom(s.module, kept, s.level) if isinstance(s, ast.ImportFrom) else ast.Import(kept)))]
                elif len(body) == 1 and block is not tree:
                    yield "unused-import", [(start, end, "pass")]
                elif not text[p.starts[s.lineno - 1] : start].strip() and not (rest := p.lines[s.end_lineno - 1][end - p.starts[s.end_lineno - 1] :]).strip():
                    yield "unused-import", [(p.starts[s.lineno - 1], min(end + len(rest) + 1, len(text)), "")]


def _plain(value: str) -> bool:
    return not any(c in value for c in "{}\\\"\n\r")


def _fstring(parts: list[str | ast.AST], text: str, p: _Places) -> str | None:
    out = []
    for x in parts:
        if isinstance(x, str):
            if not _plain(x):
                return None
            out.append(x)
        else:
            code = text[slice(*p.span(x))]
            if not isinstance(x, (ast.Name, ast.Attribute)) or not regex.fullmatch(r"[\w.]+", code):
                return None
            out.append("{" + code + "}")
    return 'f"' + "".join(out) + '"'


def _strings(node: ast.AST, text: str, p: _Places) -> Iterator[tuple[str, list[Edit]]]:
    new, kind = None, "f-string"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format" and isinstance(node.func.value, ast.Constant) and isinstance(node.func.value.value, str) and not node.keywords:
        pieces = node.func.value.value.split("{}")
        if len(pieces) == len(node.args) + 1 > 1:
            new = _fstring([x for k, piece in enumerate(pieces) for x in (piece, *node.args[k : k + 1])], text, p)
    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str):
        pieces = regex.split(r"%s", node.left.value)
        given = node.right.elts if isinstance(node.right, ast.Tuple) else [node.right]
        if "%" not in "".join(pieces) and len(pieces) == len(given) + 1 > 1 and isinstance(node.right, ast.Tuple):
            new = _fstring([x for k, piece in enumerate(pieces) for x in (piece, *given[k : k + 1])], text, p)
    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        terms, todo = [], [node]
        while todo:
            x = todo.pop()
            todo += [x.right, x.left] if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add) else []
            terms += [] if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add) else [x]
        literal = [isinstance(x, ast.Constant) and isinstance(x.value, str) for x in terms]
        if any(literal) and not all(literal) and len(terms) > 2:
            new, kind = _fstring([x.value if own else x for x, own in zip(terms, literal, strict=True)], text, p), "concatenation"
    if new is not None:
        yield kind, [(*p.span(node), new)]


def _compare(node: ast.Compare, text: str, p: _Places) -> Iterator[tuple[str, list[Edit]]]:
    left = node.left
    for op, right in zip(node.ops, node.comparators, strict=True):
        if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, bool)):
            a, b = p.span(left)[1], p.span(right)[0]
            if (m := regex.fullmatch(r"([\s)]*)(==|!=)([\s(]*)", text[a:b])) and "\n" not in m[0]:
                pad = lambda x, side: x if x else side
                yield "none-comparison", [(a, b, f"{pad(m[1], ' ')}{'is' if m[2] == '==' else 'is not'}{pad(m[3], ' ')}")]
        left = right


def _defaults(f: ast.AST, text: str, p: _Places) -> Iterator[tuple[str, list[Edit]]]:
    positional = [*f.args.posonlyargs, *f.args.args]
    pairs = [*zip(positional[len(positional) - len(f.args.defaults) :], f.args.defaults, strict=True), *((a, d) for a, d in zip(f.args.kwonlyargs, f.args.kw_defaults, strict=True) if d is not None)]
    first = f.body[1] if ast.get_docstring(f) is not None and len(f.body) > 1 else f.body[0]
    at = p.starts[first.lineno - 1]
    if first.lineno == f.lineno or text[at : p.span(first)[0]].strip() or getattr(first, "decorator_list", None) or ast.get_docstring(f) is not None and len(f.body) == 1:
        return
    for a, d in pairs:
        if isinstance(d, (ast.List, ast.Dict, ast.Set)) and "\n" not in (code := text[slice(*p.span(d))]):
            pad = text[at : p.span(first)[0]]
            step = pad[f.col_offset :] or "    "
            yield "mutable-default", [(*p.span(d), "None"), (at, at, f"{pad}if {a.arg} is None:\n{pad}{step}{a.arg} = {code}\n")]


def python_edits(text: str) -> Iterator[tuple[str, list[Edit]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    p = _Places(text)
    yield from _imports(tree, text, p)
    inside: set[int] = set()
    for x in ast.walk(tree):
        if isinstance(x, ast.JoinedStr):  # no edits in strings
            inside |= {id(y) for y in ast.walk(x)}
        if id(x) in inside:
            continue
        if isinstance(x, ast.Compare):
            yield from _compare(x, text, p)
        elif isinstance(x, ast.ExceptHandler) and x.type is None:
            start = p.span(x)[0]
            if m := regex.compile(r"except(\s*):").match(text, start):
                yield "bare-except", [(start, m.end(), "except Exception:")]
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _defaults(x, text, p)
        elif isinstance(x, (ast.Call, ast.BinOp)):
            yield from _strings(x, text, p)
            while isinstance(x, ast.BinOp) and isinstance(x.op, ast.Add):  # a chain is one
                x = x.left
                inside.add(id(x))


_JS = {
    "equality": regex.compile(r"(?<![=!<>])(==|!=)(?!=)"),
    "optional-chaining": regex.compile(r"(?<![\w.$?])([\w$]+(?:\.[\w$]+)*)\s*&&\s*\1\.(?=[\w$])"),
    "template": regex.compile(r"""(?<![+\w$)\]"'`]\s*)(?P<a>"[^"\n]*"|'[^'\n]*')\s*\+\s*(?P<x>[A-Za-z_$][\w$.]*)(?:\s*\+\s*(?P<b>"[^"\n]*"|'[^'\n]*'))?(?!\s*[+*/%(\[?.-]|[ \t]*[\w$])"""),
}


def javascript_edits(text: str) -> Iterator[tuple[str, list[Edit]]]:
    code = blank(text, "javascript")
    for m in regex.finditer(r"\bvar\s+([A-Za-z_$][\w$]*)(\s*=(?!=)|\s*[;,\n]|\s+(?:of|in)\b)", code):
        changed = regex.search(rf"(?<![.\w$]){regex.escape(m[1])}\s*(?:=(?![=>])|[-+*/%&|^]=|<<=|>>=|\*\*=|\+\+|--)|(?:\+\+|--)\s*{regex.escape(m[1])}(?![\w$])", code[: m.start()] + " " * (m.end() - m.start()) + code[m.end() :])
        more = regex.match(r"[^;\n]*,", code[m.end() - 1 :]) and not regex.match(r"[^;\n,]*[(\[{]", code[m.end() - 1 :])
        yield "var", [(m.start(), m.start() + 3, "const" if m[2].strip() and m[2].strip()[0] in "=oi" and not changed and not more else "let")]
    for m in _JS["equality"].finditer(code):
        yield "equality", [(*m.span(), m[0] + "=")]
    for m in _JS["optional-chaining"].finditer(code):
        yield "optional-chaining", [(*m.span(), m[1] + "?.")]
    for m in _JS["template"].finditer(code):
        a, b = text[slice(*m.span("a"))][1:-1], text[slice(*m.span("b"))][1:-1] if m["b"] else ""
        if "`" not in a + b and "${" not in a + b and "\\" not in a + b:
            yield "template", [(*m.span(), f"`{a}${{{m['x']}}}{b}`")]
    for m in regex.finditer(r"\bfunction\s*(\([^()]*\))\s*\{", code):
        depth, end = 0, -1
        for x in regex.finditer(r"[{}]", code[m.end() - 1 :]):
            depth += 1 if x[0] == "{" else -1
            if not depth:
                end = m.end() - 1 + x.start()
                break
        if end > 0 and not regex.search(r"\b(?:this|arguments|super|yield)\b|\bnew\.target\b", code[m.end() : end]) and not regex.search(r"(?:\bnew|\basync|\*)\s*$", code[: m.start()]) and regex.search(r"[=(,:?]\s*$|\breturn\s*$", code[: m.start()]):
            yield "arrow", [(m.start(), m.end(), f"{text[slice(*m.span(1))]} => {{")]
    for m in regex.finditer(r"\|\|(?!=)", code):
        line = code[code.rfind("\n", 0, m.start()) + 1 : (code.find("\n", m.end()) + 1 or len(code) + 1) - 1]
        if regex.search(r"=\s*[\w$.]+\s*$", code[code.rfind("\n", 0, m.start()) + 1 : m.start()]) and "&&" not in line and line.count("||") == 1 and not regex.search(r"\b(?:if|while|for)\b", line):
            yield "nullish", [(*m.span(), "??")]


FINDERS = {"python": python_edits, "javascript": javascript_edits, "typescript": javascript_edits}


def propose_edits(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key`` and COLUMNS: every edit of every fix in Python, JavaScript and TypeScript files; places are characters from 0. Null texts and texts that do not parse have none."""
    own = files.where(files["language"].isin(*FINDERS)).select(key, "language", text)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        for b in batches:
            shape = pa.schema([b.schema.field(0), *(pa.field(n, kinds[c.split()[1]]) for n, c in zip(names, COLUMNS.split(", "), strict=True))])
            rows = []
            for k, language, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for number, (kind, edits) in enumerate(FINDERS[language](t) if t else ()):
                    for start, end, new in edits:
                        first = t.count("\n", 0, start) + 1
                        rows.append((k, number, kind, start, end, new, first, first + t.count("\n", start, end), *KINDS[kind]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {COLUMNS}")


def parses(text: str, language: str) -> bool:
    """Python: whether it compiles to a tree. JavaScript: whether its brackets pair outside of strings and comments."""
    if language == "python":
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True
    stack = []
    for c in regex.findall(r"[()\[\]{}]", blank(text, language)):
        if c in "([{":
            stack.append(c)
        elif not stack or stack.pop() + c not in ("()", "[]", "{}"):
            return False
    return not stack


def put(text: str, language: str, fixes: list[list[Edit]]) -> tuple[str, int]:
    """The text with those fixes that leave it parsing, and how many they are."""
    whole = sorted((e for f in fixes for e in f), reverse=True)
    out = text
    for start, end, new in whole:
        out = out[:start] + new + out[end:]
    if parses(out, language):
        return out, len(fixes)
    kept: list[list[Edit]] = []
    for f in fixes:  # one by one
        out = text
        for start, end, new in sorted((e for x in [*kept, f] for e in x), reverse=True):
            out = out[:start] + new + out[end:]
        if parses(out, language):
            kept.append(f)
    out = text
    for start, end, new in sorted((e for x in kept for e in x), reverse=True):
        out = out[:start] + new + out[end:]
    return out, len(kept)


def apply_edits(files: DataFrame, edits: DataFrame, key: str = "file_path", text: str = "content", safe_only: bool = False) -> DataFrame:
    """``key, content, applied`` for every file: its text with its fixes.

    Of fixes whose spans overlap the surest stays (``resolve_conflicts``, with places for lines); a fix goes in with all its
    edits or not at all. Files without edits come back as they are.
    """
    e = edits.where("safe") if safe_only else edits
    spans = e.select(F.col(key).cast("string").alias("file_path"), F.col("start").alias("line_start"), F.greatest(F.col("end") - 1, "start").alias("line_end"), (F.col("fix") * 8192 + F.row_number().over(_edit_order(key)) % 8192).alias("ord"), "confidence")
    kept = resolve_conflicts(spans).select("file_path", F.floor(F.col("ord") / 8192).cast("long").alias("fix"))
    need = e.groupBy(F.col(key).cast("string").alias("file_path"), "fix").agg(F.count("*").alias("edits"))
    whole = kept.groupBy("file_path", "fix").agg(F.count("*").alias("n")).join(need, ["file_path", "fix"]).where("n = edits").select(F.col("file_path").alias("_key"), F.col("fix").alias("_fix"))
    chosen = e.join(whole, (F.col(key).cast("string") == F.col("_key")) & (F.col("fix") == F.col("_fix")), "left_semi")
    fixes = chosen.groupBy(key, "fix").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("fix", "e"))).alias("_fixes"))
    todo = files.join(fixes, key, "left").select(key, "language", text, F.transform("_fixes", lambda x: x["e"]).alias("_fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, applied = [], []
            for language, t, found in zip(*(b.column(c).to_pylist() for c in ("language", text, "_fixes")), strict=True):
                out, n = put(t, language, [[(x["start"], x["end"], x["new_text"]) for x in f] for f in found]) if found else (t, 0)
                texts.append(out)
                applied.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(applied, pa.int64())], [key, "content", "applied"])

    return todo.mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, content string, applied long")


def _edit_order(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("start", "end", "fix")
