"""Regular-expression matches with exact positions, as column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(pattern: str, ignore_case: bool = False, multi_line: bool = False, dot_all: bool = False) -> str:
    """``pattern`` for Java with the meaning that these flags give it elsewhere: Unicode classes, only \\n ends a line."""
    return "(?Ud" + "i" * ignore_case + "m" * multi_line + "s" * dot_all + ")" + pattern


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> Column:
    """Array of (start, line, col, text) of all matches in a column, counted from 0, 1 and 1.

    The pieces between matches and the matches themselves give the offsets as running sums. A text
    without a match gives null, after one look.
    """
    p = _literal(pattern)
    before = f"substring({text}, 1, r.start)"
    return F.expr(f"""CASE WHEN {text} rlike {p} THEN
      transform(array(struct(regexp_extract_all({text}, {p}, 0) AS m, transform(split({text}, {p}, -1), x -> length(x)) AS g)), s ->
        transform(aggregate(s.m, struct(cast(array() AS array<struct<start:int,text:string>>) AS a, 0 AS at), (acc, x) ->
            struct(concat(acc.a, array(struct(acc.at + get(s.g, size(acc.a)) AS start, x AS text))) AS a, acc.at + get(s.g, size(acc.a)) + length(x) AS at)).a,
          r -> struct(r.start AS start, length({before}) - length(replace({before}, '\\n', '')) + 1 AS line, length(substring_index({before}, '\\n', -1)) + 1 AS col, r.text AS text)))[0]
      END""")


def count(text: str, pattern: str) -> Column:
    """Number of matches."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0))


def glob(path: Column | str, pattern: str) -> Column:
    """Whether the whole of ``path`` fits a shell pattern."""
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike("^" + fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$"))


def glob_of(path: Column, pattern: Column) -> Column:
    """Whether the whole of ``path`` fits a shell pattern that is data: ``*`` any run, ``?`` any character, ``[a-z]`` and ``[!a-z]`` sets; a bracket that nothing closes is itself."""
    p = F.regexp_replace(pattern, r"([.^$+(){}|\\])", r"\\$1")
    p = F.regexp_replace(p, r"\[(?![!^]?\]?[^\]]*\])", r"\\[")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\[!", "[^"), r"\*", ".*"), r"\?", ".")
    return F.regexp_like(path, F.concat(F.lit("(?s)^(?:"), p, F.lit(")$(?!\\n)")))


def glob_any_part(path: str, patterns: list[str]) -> Column:
    """Whether any pattern fits the whole path, its last part, or any part of it."""
    found = F.lit(False)
    for p in patterns:
        found = found | glob(path, p) | F.exists(F.split(path, "/"), _fits(p))
    return found


def _fits(pattern: str):
    return lambda part: glob(part, pattern)


def prefix_glob(path: Column | str, pattern: str) -> Column:
    """The simple form: ``*`` any run, ``?`` any character, anything may follow."""
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike("^" + pattern.replace("*", ".*").replace("?", "."))
