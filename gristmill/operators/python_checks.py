"""Checks of Python sources on their syntax trees: smells, dead code, imports, security, performance, types, taint.

A check looks at one node and yields findings; the table at the end says which checks see which kind
of node, so a tree is walked once. Files go through in batches; other languages never reach Python.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .metrics import cyclomatic_analysis

SCHEMA = "check string, severity string, category string, line_start long, message string"
Found = tuple[str, str, str, int, str]
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_BLOCKS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try)

# Limits of a function.
MAX_PATHS, MAX_LINES, MAX_PARAMETERS, MAX_DEPTH = 10, 50, 5, 4
# What a line with a secret looks like.
SECRETS = (
    (r"""password\s*=\s*["'](?!.*\{)[^"']{8,}["']""", "Hardcoded password"),
    (r"""api[_-]?key\s*=\s*["'][^"']{20,}["']""", "Hardcoded API key"),
    (r"""secret[_-]?key\s*=\s*["'][^"']{20,}["']""", "Hardcoded secret key"),
    (r"""token\s*=\s*["'][^"']{20,}["']""", "Hardcoded token"),
    (r"aws[_-]?access[_-]?key", "AWS access key"),
    (r"""private[_-]?key\s*=\s*["']""", "Private key"),
)
# Calls that bring in outside data, and calls that must not get it, with their kind.
TAINT_SOURCES = {
    "input": "user_input", "raw_input": "user_input", "sys.argv": "user_input", "request.args.get": "user_input", "request.form.get": "user_input", "request.json.get": "user_input",
    "request.GET.get": "user_input", "request.POST.get": "user_input", "request.body": "user_input", "os.environ.get": "environment", "os.getenv": "environment",
    "open": "file", "file.read": "file", "Path.read_text": "file", "requests.get": "network", "requests.post": "network", "urllib.request.urlopen": "network", "socket.recv": "network",
}
TAINT_SINKS = {
    "execute": "sql", "executemany": "sql", "os.system": "command", "subprocess.call": "command", "subprocess.run": "command", "subprocess.Popen": "command", "eval": "eval", "exec": "eval",
    "open": "file", "os.remove": "file", "os.unlink": "file", "shutil.rmtree": "file", "requests.get": "network", "requests.post": "network", "urllib.request.urlopen": "network",
}
SINK_SEVERITY = {"sql": "critical", "command": "critical", "eval": "critical", "file": "high", "network": "high"}
TAINTED_PARAMETERS = ("request", "req", "data", "input", "params")


def dotted(node: ast.AST) -> str:
    """The name of what is called, with its dots, as far as it is made of names."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _varies(node: ast.AST) -> bool:
    return any(isinstance(x, (ast.Name, ast.JoinedStr, ast.BinOp)) for x in ast.walk(node))


def function_size(f: ast.AST) -> Iterator[Found]:
    paths, lines = cyclomatic_analysis(f), (f.end_lineno or f.lineno) - f.lineno + 1
    if paths > MAX_PATHS:
        yield "complexity", "high" if paths > 20 else "medium" if paths > 15 else "low", "complexity", f.lineno, f"Function '{f.name}' has high cyclomatic complexity ({paths})"
    if lines > MAX_LINES:
        yield "function-length", "medium" if lines > 100 else "low", "maintainability", f.lineno, f"Function '{f.name}' is too long ({lines} lines)"
    a = f.args
    n = len(a.args) + len(a.posonlyargs) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
    if n > MAX_PARAMETERS:
        yield "parameters", "low", "maintainability", f.lineno, f"Function '{f.name}' has too many parameters ({n})"
    depth = _depth(f)
    if depth > MAX_DEPTH:
        yield "nesting", "medium", "complexity", f.lineno, f"Function '{f.name}' has deep nesting (depth: {depth})"


def _depth(node: ast.AST, at: int = 0) -> int:
    return max([at, *(_depth(x, at + isinstance(x, _BLOCKS)) for x in ast.iter_child_nodes(node))])


def mutable_default(f: ast.AST) -> Iterator[Found]:
    if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in f.args.defaults):
        yield "mutable-default", "high", "smell", f.lineno, f"Function '{f.name}' has mutable default argument"


def return_annotation(f: ast.AST) -> Iterator[Found]:
    if f.returns is None and not f.name.startswith("_") and any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(f)):
        yield "return-annotation", "low", "type_safety", f.lineno, f"Function '{f.name}' is missing return type annotation"
    bare = [a.arg for a in f.args.args if a.annotation is None and a.arg not in ("self", "cls")]
    if bare and any(a.annotation is not None for a in f.args.args):
        yield "partial-annotations", "medium", "type_safety", f.lineno, f"Function '{f.name}' has inconsistent type annotations (some parameters annotated, some not)"


def unreachable(f: ast.AST) -> Iterator[Found]:
    for node in ast.walk(f):
        for block in (getattr(node, "body", None), getattr(node, "orelse", None)):
            if not isinstance(block, list):
                continue
            for stmt, after in zip(block, block[1:], strict=False):
                if isinstance(stmt, (ast.Return, ast.Raise)):
                    yield "unreachable", "medium", "dead_code", after.lineno, "Unreachable code after return statement"


def handler(h: ast.AST) -> Iterator[Found]:
    if h.type is None:
        yield "bare-except", "medium", "smell", h.lineno, "Bare except clause catches all exceptions"
    if len(h.body) == 1 and isinstance(h.body[0], ast.Pass):
        yield "swallowed", "medium", "smell", h.lineno, "Exception silently swallowed with 'pass'"


def wildcard(node: ast.AST) -> Iterator[Found]:
    if any(a.name == "*" for a in node.names):
        yield "wildcard-import", "low", "imports", node.lineno, f"Wildcard import from '{node.module}'"


def call(c: ast.AST) -> Iterator[Found]:
    name, line = dotted(c.func), c.lineno
    words = {k.arg: k.value for k in c.keywords}
    if name in ("eval", "exec"):
        yield "eval", "critical", "security", line, f"Dangerous use of {name}(): can execute arbitrary code"
    shell = words.get("shell")
    if isinstance(shell, ast.Constant) and shell.value is True and name.startswith(("subprocess.", "os.")) and c.args and _varies(c.args[0]):
        yield "shell", "critical", "security", line, "Command injection risk: shell=True with variable input"
    if "pickle.load" in name:
        yield "pickle", "high", "security", line, "Insecure deserialization: pickle can execute arbitrary code"
    if "yaml.load" in name and "SafeLoader" not in (ast.unparse(words["Loader"]) if "Loader" in words else ""):
        yield "yaml", "high", "security", line, "Insecure YAML deserialization: yaml.load() without SafeLoader"
    for algorithm, text in (("md5", "Weak cryptographic hash: MD5 is cryptographically broken"), ("sha1", "Weak cryptographic hash: SHA-1 is deprecated for security")):
        if name.endswith(f"hashlib.{algorithm}"):
            yield algorithm, "medium", "security", line, text
    if "random.random" in name or "random.randint" in name:
        yield "random", "medium", "security", line, "Insecure random number generation"
    if name.endswith("mktemp"):
        yield "mktemp", "high", "security", line, "Insecure temporary file creation: mktemp() is vulnerable to race conditions"
    if name.endswith(("requests.get", "requests.post", "urlopen")) and c.args and _varies(c.args[0]):
        yield "ssrf", "high", "security", line, "Potential SSRF: HTTP request with user-controlled URL"
    if name == "open" and c.args and isinstance(c.args[0], (ast.BinOp, ast.JoinedStr)):
        yield "path", "high", "security", line, "Potential path traversal: file operation with variable path"
    if name.rsplit(".", 1)[-1] in ("execute", "executemany") and c.args:
        q = c.args[0]
        how = "f-string" if isinstance(q, ast.JoinedStr) else "% formatting" if isinstance(q, ast.BinOp) and isinstance(q.op, ast.Mod) else "string concatenation" if isinstance(q, ast.BinOp) else ".format()" if isinstance(q, ast.Call) and dotted(q.func).endswith("format") else None
        if how:
            yield "sql", "critical", "security", line, f"Potential SQL injection: {how} used in SQL query"


def compare(c: ast.AST) -> Iterator[Found]:
    for op, right in zip(c.ops, c.comparators, strict=True):
        constant = isinstance(right, ast.Constant)
        if constant and right.value is None and isinstance(op, (ast.Eq, ast.NotEq)):
            yield "none-equality", "low", "type_safety", c.lineno, "Use 'is None' or 'is not None' instead of '==' or '!=' for None checks"
        elif constant and isinstance(right.value, bool) and isinstance(op, (ast.Eq, ast.NotEq)):
            yield "bool-equality", "low", "semantic", c.lineno, f"Comparison with {right.value} is redundant"
        elif constant and isinstance(op, (ast.Is, ast.IsNot)) and right.value is not None and not isinstance(right.value, bool) and right.value is not ...:
            yield "is-literal", "medium", "semantic", c.lineno, f"Using 'is' to compare with literal value {right.value}"
    if isinstance(c.left, ast.Name) and any(w in c.left.id.lower() for w in ("password", "token", "secret", "key", "hash")) and any(isinstance(o, ast.Eq) for o in c.ops):
        yield "timing", "medium", "security", c.lineno, "Potential timing attack: string comparison on sensitive data"


def condition(node: ast.AST) -> Iterator[Found]:
    if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and ast.dump(node.orelse[0].test) == ast.dump(node.test):
        yield "same-condition", "high", "semantic", node.orelse[0].lineno, "Elif condition is identical to if condition - second branch is unreachable"
    if isinstance(node.test, ast.Call) and dotted(node.test.func).endswith(("path.exists", "isfile", ".exists")) and any(isinstance(x, ast.Call) and dotted(x.func).rsplit(".", 1)[-1] in ("open", "remove", "unlink", "rename") for s in node.body for x in ast.walk(s)):
        yield "toctou", "medium", "security", node.lineno, "Potential TOCTOU (Time-of-check Time-of-use) race condition"


def loop(node: ast.AST) -> Iterator[Found]:
    names = [dotted(x.func).lower() for x in ast.walk(node) if isinstance(x, ast.Call)]
    if any(n.rsplit(".", 1)[-1] in ("execute", "query", "filter", "get_or_create", "find_one", "save", "fetchone", "fetchall") for n in names):
        yield "query-loop", "high", "performance", node.lineno, "Potential N+1 query pattern: database call inside loop"
    if any(w in n for n in names for w in ("requests.", "urlopen", "httpx.")):
        yield "network-loop", "high", "performance", node.lineno, "Network call inside loop can cause performance issues"
    if any(isinstance(x, ast.AugAssign) and isinstance(x.op, ast.Add) for x in ast.walk(node)):
        yield "concat-loop", "medium", "performance", node.lineno, "String concatenation in loop is inefficient"
    if any(n in ("re.compile", "copy.deepcopy", "json.loads", "sorted") for n in names):
        yield "expensive-loop", "medium", "performance", node.lineno, "Expensive operation in loop"
    deep = _loops(node)
    if deep >= 3:
        yield "nested-loops", "medium", "performance", node.lineno, f"Deeply nested loops (level {deep}) can cause O(n^{deep}) complexity"


def _loops(node: ast.AST) -> int:
    return isinstance(node, (ast.For, ast.While)) + max([0, *(_loops(x) for x in ast.iter_child_nodes(node))])


#: Through which fields of an expression a value that is passed on can come, and of a statement control.
_CARRIES = {ast.Attribute: ("value",), ast.BinOp: ("left", "right"), ast.JoinedStr: ("values",), ast.FormattedValue: ("value",), ast.Call: ("args", "keywords"), ast.keyword: ("value",)}
_BODIES = {ast.If: ("body", "orelse"), ast.While: ("body", "orelse"), ast.For: ("body", "orelse"), ast.Try: ("body", "handlers"), ast.ExceptHandler: ("body",)}


@dataclass(frozen=True)
class Fact:
    """What one statement does: names it binds, names whose taint they take on, and calls of sinks.

    ``outside``: the value comes from a source. Each sink has its name, its kind and, for each
    argument, the names whose value the argument carries.
    """

    line: int
    binds: frozenset[str] = frozenset()
    takes: frozenset[str] = frozenset()
    outside: bool = False
    sinks: tuple[tuple[str, str, tuple[frozenset[str], ...]], ...] = ()


def _below(node: ast.AST, fields: dict) -> list:
    held = [getattr(node, f) for f in fields.get(type(node), ())]
    return [x for h in held for x in (h if isinstance(h, list) else [h])]


def _carried(value: ast.AST) -> frozenset[str]:
    """Names whose value reaches ``value``."""
    names, todo = set(), [value]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Name):
            names.add(node.id)
        todo += _below(node, _CARRIES)
    return frozenset(names)


def _listed(name: str, table: dict[str, str]) -> str | None:
    return next((kind for part, kind in table.items() if part in name), None)


def _fact(s: ast.stmt) -> Fact:
    value = getattr(s, "value", None)
    called = dotted(value.func) if isinstance(value, ast.Call) and isinstance(s, (ast.Assign, ast.Expr)) else ""
    kind = _listed(called, TAINT_SINKS)
    sinks = ((called, kind, tuple(map(_carried, _below(value, _CARRIES)))),) if kind else ()
    targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AugAssign) else []
    # A call's result is clean unless it is a source; names, sums and texts pass on what they are made of.
    mixed = isinstance(s, ast.AugAssign) or isinstance(value, (ast.Name, ast.BinOp, ast.JoinedStr))
    takes = frozenset(x.id for x in ast.walk(value) if isinstance(x, ast.Name)) if targets and mixed else frozenset()
    source = isinstance(s, ast.Assign) and _listed(called, TAINT_SOURCES) is not None
    return Fact(getattr(value, "lineno", s.lineno), frozenset(t.id for t in targets if isinstance(t, ast.Name)), takes, source, sinks)


def facts(body: list[ast.AST]) -> Iterator[Fact]:
    """Facts of all statements in the order of the text; branches follow each other, definitions are not entered."""
    for s in body:
        if type(s) in _BODIES:
            yield from facts(_below(s, _BODIES))
        elif isinstance(s, (ast.Assign, ast.AugAssign, ast.Expr)):
            yield _fact(s)


def flow(body: list[ast.stmt], tainted: Iterable[str]) -> Iterator[Found]:
    """One pass over the facts: taint only grows, and a sink's argument that carries any is found."""
    known = set(tainted)
    for fact in facts(body):
        if fact.outside or known & fact.takes:
            known |= fact.binds
        for name, kind, arguments in fact.sinks:
            for _ in filter(known.intersection, arguments):
                yield "taint", SINK_SEVERITY[kind], "dataflow", fact.line, f"Tainted data flows to {name} ({kind})"


def function_flow(f: ast.AST) -> Iterator[Found]:
    yield from flow(f.body, (a.arg for a in f.args.args if a.arg in TAINTED_PARAMETERS))


def module(tree: ast.AST) -> Iterator[Found]:
    """What needs the whole file: imports and functions that nothing uses, functions that occur twice, module-level flow."""
    used = {x.id for x in ast.walk(tree) if isinstance(x, ast.Name)}
    imported = {}
    for x in ast.walk(tree):
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            imported.update({a.asname or a.name: x.lineno for a in x.names if a.name != "*"})
    for name in sorted(set(imported) - used):
        yield "unused-import", "info", "imports", imported[name], f"Unused import: '{name}'"
    dumps: dict[str, str] = {}
    for x in ast.walk(tree):
        if isinstance(x, ast.FunctionDef) and not x.name.startswith(("_", "test_")) and x.name not in used and x.name != "main":
            yield "unused-function", "info", "dead_code", x.lineno, f"Function '{x.name}' appears to be unused"
        if isinstance(x, _FUNCTION):
            if (d := ast.dump(x)) in dumps:
                yield "duplicate", "low", "smell", x.lineno, f"Function '{x.name}' appears to be duplicate of '{dumps[d]}'"
            dumps.setdefault(d, x.name)
    yield from flow(tree.body, ())


def lines_of(code: str) -> Iterator[Found]:
    for i, line in enumerate(code.split("\n"), 1):
        if re.search(r"#\s*(TODO|FIXME)", line):
            yield "todo", "info", "smell", i, "TODO/FIXME comment found"
        for pattern, what in SECRETS:
            if re.search(pattern, line, re.IGNORECASE):
                yield "secret", "critical", "security", i, f"{what} detected in code"


CHECKS = {
    ast.FunctionDef: (function_size, mutable_default, return_annotation, unreachable, function_flow),
    ast.AsyncFunctionDef: (function_size, mutable_default, return_annotation, unreachable, function_flow),
    ast.ExceptHandler: (handler,), ast.ImportFrom: (wildcard,), ast.Call: (call,), ast.Compare: (compare,), ast.If: (condition,), ast.For: (loop,), ast.While: (loop,), ast.Module: (module,),
}


def check_source(code: str) -> list[Found]:
    """All findings of a source text; one, a syntax error, if it does not parse."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [("syntax", "critical", "syntax", e.lineno or 1, f"Syntax error: {e.msg}")]
    except (ValueError, RecursionError, MemoryError) as e:
        return [("syntax", "critical", "syntax", 1, f"Syntax error: {e}")]
    found = [x for node in ast.walk(tree) for check in CHECKS.get(type(node), ()) for x in check(node)]
    return found + list(lines_of(code))


def check_files(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key`` and SCHEMA: findings of each Python file."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *f) for k, t in zip(b[key], b[text], strict=True) if t for f in check_source(t)], columns=[key, *names])

    own = files.where("language = 'python'").select(key, text)
    return own.mapInPandas(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {SCHEMA}")
