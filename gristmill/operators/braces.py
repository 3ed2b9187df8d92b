"""Checks that need the block behind an opening brace: goroutines, loops, function bodies.

Regular expressions cannot pair braces, so these few checks run in Python, a batch of files at a time,
on files of their languages only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "check string, severity string, category string, line_start long, line_end long, message string"
MAX_PATHS, MAX_LINES = 10, 50
_GO_LOOP = re.compile(r"for\s+.*\{")
_JS_FUNCTION = re.compile(r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))")
# What adds a path through a JavaScript function.
_JS_PATHS = [re.compile(p) for p in (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\b\?\s*[^:]+:", r"\|\|", r"&&")]
# What must not be in the body of a Go loop, unless the other is there.
_GO_LOOP_CHECKS = (
    ("go-query-loop", "high", re.compile(r"\.(?:Query|QueryRow|Exec|Find|First|Get)\s*\("), None, "N+1 query pattern: Database query inside loop"),
    ("go-concat-loop", "medium", re.compile(r"""\w+\s*\+=\s*["']|\w+\s*=\s*\w+\s*\+\s*["']"""), "strings.Builder", "Inefficient string concatenation in loop"),
    ("go-defer-loop", "medium", re.compile(r"defer "), None, "defer in loop: Deferred functions accumulate until function returns"),
    ("go-json-loop", "medium", re.compile(r"json\.(?:Marshal|Unmarshal)"), None, "JSON encoding in loop"),
)


def closing(text: str, at: int) -> int:
    """Where the brace that opens at ``at`` closes, -1 if nowhere."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def go_checks(text: str) -> Iterator[tuple]:
    for m in re.finditer(r"go\s+func\s*\([^)]*\)\s*\{", text):
        end = closing(text, m.end() - 1)
        body = text[m.start() : end if end > 0 else len(text)]
        if not any(w in body for w in ("context.Context", "ctx.Done()", "<-done", "time.After", "select")):
            yield "go-goroutine-leak", "high", "performance", _line(text, m.start()), _line(text, m.start()), "Potential goroutine leak: No cancellation mechanism detected"
    for m in _GO_LOOP.finditer(text):
        end = closing(text, m.end() - 1)
        body = text[m.end() : end if end > 0 else len(text)]
        line = _line(text, m.start())
        for check, grave, pattern, unless, message in _GO_LOOP_CHECKS:
            if pattern.search(body) and not (unless and unless in body):
                yield check, grave, "performance", line, line, message


def js_checks(text: str) -> Iterator[tuple]:
    """Paths and lines of functions with a block."""
    for m in _JS_FUNCTION.finditer(text):
        begin = text.find("{", m.start())
        end = closing(text, begin) if begin >= 0 else -1
        if end < 0:
            continue
        name, first, last = m[1] or m[2], _line(text, m.start()), _line(text, end)
        paths = 1 + sum(len(p.findall(text[begin:end])) for p in _JS_PATHS)
        if paths > MAX_PATHS:
            yield "js-complexity", "high" if paths > 20 else "medium" if paths > 15 else "low", "complexity", first, last, f"Function '{name}' has high cyclomatic complexity ({paths})"
        if last - first + 1 > MAX_LINES:
            yield "js-function-length", "medium" if last - first + 1 > 100 else "low", "maintainability", first, last, f"Function '{name}' is too long ({last - first + 1} lines)"


BY_LANGUAGE = {"go": go_checks, "javascript": js_checks, "typescript": js_checks}


def check_blocks(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key`` and SCHEMA: findings in blocks of Go, JavaScript and TypeScript files."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *f) for k, lang, t in zip(b[key], b["language"], b[text], strict=True) if t for f in BY_LANGUAGE[lang](t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    own = files.where(files["language"].isin(*BY_LANGUAGE)).select(key, "language", text)
    return own.mapInPandas(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {SCHEMA}")
