"""Copies of Python code whatever its names: fingerprints of subtrees, and classes of equal ones across files.

Each function, class, loop, test, with, try or match block of enough nodes gets a fingerprint of its
syntax with the names that its function binds replaced by numbers in order of appearance; names
from outside (globals, built-ins, attributes, keywords) and constants count. Equal fingerprints make a class. A
class is one row, its members are rows, and pairs are never made.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = [
    ("fingerprint", pa.string()), ("parent", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("nodes", pa.int64()), ("depth", pa.int64()),
]
SCHEMA = "fingerprint string, parent string, kind string, name string, line_start long, line_end long, nodes long, depth long"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
ROOTS = (*_FUNCTION, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match)
#: Fields that say nothing about what code does.
_SKIPPED = {"ctx", "type_comment", "type_ignores", "kind", "lineno", "col_offset", "end_lineno", "end_col_offset"}


def bound_names(f: ast.AST) -> set[str]:
    """Names that a function, or a file outside of functions, binds for itself: arguments, targets, imports, definitions."""
    out, outside, todo = set(), set(), [f]
    while todo:
        x = todo.pop()
        if isinstance(x, ast.arg):
            out.add(x.arg)
        elif isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
            out.add(x.id)
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            outside |= set(x.names)
        elif isinstance(x, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and x.name:
            out.add(x.name)
        elif isinstance(x, ast.MatchMapping) and x.rest:
            out.add(x.rest)
        elif isinstance(x, (*_FUNCTION, ast.ClassDef)):
            out.add(x.name)
        elif isinstance(x, ast.alias):
            outside.add(x.asname or x.name.partition(".")[0])  # what it names is what it does
        todo += ast.iter_child_nodes(x)
    return out - outside


def canonical(node: ast.AST, local: set[str] | frozenset[str]) -> tuple[list[str], int]:
    """The syntax below ``node`` as words, in order, with ``local`` names as numbers; and how many nodes there are."""
    words, numbers, nodes = [], {}, 0
    todo: list[object] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, ast.AST):
            nodes += 1
            words.append(type(x).__name__)
            parts = []
            for name, value in ast.iter_fields(x):
                if name in _SKIPPED or value is None and not isinstance(x, ast.Constant):
                    continue
                is_name = isinstance(value, str) and name in ("id", "arg", "name", "rest") and not isinstance(x, (ast.keyword, ast.alias))
                parts += [f".{name}", f"#{numbers.setdefault(value, len(numbers))}" if is_name and value in local else value]
            todo += reversed(parts)
        elif isinstance(x, list):
            todo += [f"]{len(x)}", *reversed(x)]
        else:
            words.append(x if isinstance(x, str) and x[:1] in ".#]" else repr(x))
    return words, nodes


def subtrees(code: str, least_nodes: int) -> Iterator[tuple]:
    """Rows of COLUMNS of a source text; none if it does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    # Names belong to the outermost function around them; a file's own names are known to other files.
    todo: list[tuple[ast.AST, frozenset[str] | None, str | None, int]] = [(tree, None, None, 0)]
    while todo:
        x, local, parent, depth = todo.pop()
        if isinstance(x, ROOTS):
            if local is None and isinstance(x, (*_FUNCTION, ast.ClassDef)):
                local = frozenset(bound_names(x))
            words, nodes = canonical(x, local or frozenset())
            if nodes >= least_nodes:
                own = hashlib.sha256("\0".join(words).encode("utf-8", "surrogatepass")).hexdigest()[:32]
                yield own, parent, type(x).__name__, getattr(x, "name", None), x.lineno, x.end_lineno or x.lineno, nodes, depth
                parent, depth = own, depth + 1
        todo += [(c, local, parent, depth) for c in reversed(list(ast.iter_child_nodes(x)))]


def fingerprints(files: DataFrame, key: str = "file_path", text: str = "content", least_nodes: int = 12) -> DataFrame:
    """``key`` and COLUMNS: every block of ``least_nodes`` nodes or more of each Python file; ``parent`` is the next such block around it.

    Null texts and texts that do not parse have none. Repeated files have repeated rows.
    """
    own = files.where("language = 'python'").select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape = pa.schema([b.schema.field(0), *(pa.field(n, t) for n, t in COLUMNS)])
            rows = [(k, *r) for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t for r in subtrees(t, least_nodes)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, {SCHEMA}")


def clone_classes(prints: DataFrame, key: str = "file_path") -> DataFrame:
    """One row for each fingerprint that stands in several places: ``fingerprint, kind, nodes, members, first`` (the first place: key, line_start, name) and ``maximal``.

    A class is not maximal if all its members lie in members of one larger class, in each as often: then the copies are
    longer than it. Counts are combined before the shuffle; a class of any size is one row.
    """
    place = F.struct(key, "line_start", "name")
    c = prints.groupBy("fingerprint").agg(
        F.min("kind").alias("kind"), F.min("nodes").alias("nodes"), F.count("*").alias("members"), F.min(place).alias("first"),
        F.min("parent").alias("parent"), F.max("parent").alias("last_parent"), F.count("parent").alias("parents"),
    ).where("members > 1")
    around = c.select(F.col("fingerprint").alias("parent"), F.col("members").alias("around"))
    one = (F.col("parent") == F.col("last_parent")) & (F.col("parents") == F.col("members"))
    c = c.withColumn("parent", F.when(one, F.col("parent"))).join(around, "parent", "left")
    return c.select("fingerprint", "kind", "nodes", "members", "first", F.col("around").isNull().alias("maximal"))


def clone_members(prints: DataFrame, key: str = "file_path", maximal: bool = True) -> DataFrame:
    """Every member of every class: its row of ``prints`` with ``members``, ``first_key``, ``first_line``, ``first_name`` and ``is_first``.

    A class of a hundred thousand members gives as many rows: each member meets its class's one row, and a
    frequent fingerprint is split by AQE like any skewed side of a join.
    """
    c = clone_classes(prints, key)
    c = (c.where("maximal") if maximal else c).select("fingerprint", "members", F.col(f"first.`{key}`").alias("first_key"), F.col("first.line_start").alias("first_line"), F.col("first.name").alias("first_name"))
    out = prints.join(c, "fingerprint")
    return out.withColumn("is_first", (F.col(key) == F.col("first_key")) & (F.col("line_start") == F.col("first_line")))


def duplicate_functions(files: DataFrame, key: str = "file_path", text: str = "content", least_nodes: int = 12) -> DataFrame:
    """``key, line_start, line_end, severity, category, message`` for each function that copies an earlier one, in its file or another."""
    m = clone_members(fingerprints(files, key, text, least_nodes), key, maximal=False).where("kind IN ('FunctionDef', 'AsyncFunctionDef') AND NOT is_first")
    message = F.concat(F.lit("Function '"), "name", F.lit("' appears to be duplicate of '"), "first_name", F.lit("'"))
    return m.select(key, "line_start", "line_end", F.lit("low").alias("severity"), F.lit("smell").alias("category"), message.alias("message"), F.col("first_key").alias("copy_of"), F.col("first_line").alias("copy_of_line"))


def consed(prints: DataFrame) -> DataFrame:
    """The distinct blocks: ``fingerprint, kind, nodes, uses, inside`` (fingerprints of the blocks right within it); each block of a corpus once."""
    edges = prints.where("parent IS NOT NULL").select("parent", "fingerprint").distinct().groupBy("parent").agg(F.sort_array(F.collect_list("fingerprint")).alias("inside"))
    nodes = prints.groupBy("fingerprint").agg(F.min("kind").alias("kind"), F.min("nodes").alias("nodes"), F.count("*").alias("uses"))
    return nodes.join(edges.withColumnRenamed("parent", "fingerprint"), "fingerprint", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))
