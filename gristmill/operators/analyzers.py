"""Analyzers by language, for DataFrames and for SQL.

An analyzer takes a source text and yields findings (check, severity, category, line, message). Those
registered for a file's language run on it: ``analyze_files`` over a DataFrame, and ``analyze`` as a table
function in SQL, by LATERAL. ``line_chunks`` is a table function over a partitioned table of lines.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from . import braces, paths, python_checks

Finding = tuple[str, str, str, int, str]
SCHEMA = "check string, severity string, category string, line_start long, message string"
_TYPES = [("check", pa.string()), ("severity", pa.string()), ("category", pa.string()), ("line_start", pa.int64()), ("message", pa.string())]


def blocks(find: Callable[[str], Iterator[tuple]]) -> Callable[[str], Iterator[Finding]]:
    """A check of blocks, which tells where a finding ends, as an analyzer."""
    return lambda text: ((check, grave, kind, first, message) for check, grave, kind, first, _, message in find(text))


#: By language, in lower case.
ANALYZERS: dict[str, list[Callable[[str], Iterator[Finding]]]] = {
    "python": [python_checks.check_source, paths.path_findings],
    "go": [blocks(braces.go_checks)],
    "javascript": [blocks(braces.js_checks)],
    "typescript": [blocks(braces.js_checks)],
}


def register(language: str, analyzer: Callable[[str], Iterator[Finding]]) -> None:
    """Have an analyzer run on the files of a language, too, from now on."""
    ANALYZERS.setdefault(language.lower(), []).append(analyzer)


def _found(analyzers: dict, language: str | None, content: str | None) -> Iterator[Finding]:
    for a in analyzers.get((language or "").lower(), ()) if content else ():
        yield from a(content)


def analyze_files(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key`` and SCHEMA: what the analyzers of each file's language find; null and empty texts, and languages without analyzers, have nothing."""
    analyzers = {k: list(v) for k, v in ANALYZERS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape = pa.schema([b.schema.field(0), *(pa.field(n, t) for n, t in _TYPES)])
            rows = [(k, *f) for k, language, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for f in _found(analyzers, language, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    own = files.select(key, "language", text)
    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {SCHEMA}")


def register_functions(spark: SparkSession) -> None:
    """Make ``analyze(language, content)`` and ``line_chunks(TABLE(lines) PARTITION BY ... ORDER BY ..., max_tokens, overlap)`` known in SQL.

    ``analyze`` has the analyzers that are registered now.
    """
    analyzers = {k: list(v) for k, v in ANALYZERS.items()}

    class Analyze:
        def eval(self, language: str, content: str) -> Iterator[tuple]:
            yield from _found(analyzers, language, content)

    class LineChunks:
        """Chunks of the lines of a partition (file_path, line), in order; no more lines are held than a chunk has."""

        def __init__(self) -> None:
            self.lines: deque[str] = deque()
            self.path, self.chunk, self.begin, self.size, self.step = None, 0, 0, 0, 0
            self.before: deque[str] = deque()

        def eval(self, row: Row, max_tokens: int, overlap: int) -> Iterator[tuple]:
            if not self.size:
                self.size = max(max_tokens * 4 // 50, 50)
                self.step, self.path, self.before = max(1, self.size - overlap), row["file_path"], deque(maxlen=overlap)
            if len(self.lines) == self.size:
                yield self.made()
                for _ in range(self.step):
                    self.before.append(self.lines.popleft())
                self.chunk, self.begin = self.chunk + 1, self.begin + self.step
            self.lines.append(row["line"])

        def made(self) -> tuple:
            return self.path, self.chunk, self.begin + 1, self.begin + len(self.lines), "\n".join(self.lines), "\n".join(self.before) if self.chunk else None

        def terminate(self) -> Iterator[tuple]:
            if self.lines:
                yield self.made()

    spark.udtf.register("analyze", udtf(Analyze, returnType=SCHEMA, useArrow=True))
    spark.udtf.register("line_chunks", udtf(LineChunks, returnType="file_path string, chunk int, start_line int, end_line int, content string, context string"))
