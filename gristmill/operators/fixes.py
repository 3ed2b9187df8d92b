"""Fixes for findings: rewrites of the lines that a finding names, chosen by its message.

A fix is a row of a table: which words in the message call for it, what it rewrites, how sure and safe
it is. All of it becomes one CASE expression; findings meet their file's text by a join on the path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rewrite:
    id: str
    languages: tuple[str, ...]
    words: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]
    category: str
    confidence: float
    safe: bool
    description: str


_JS = ("javascript", "typescript")
# What is rewritten, and how far it can be trusted.
REWRITES = (
    Rewrite("unused-import", ("python",), ("unused import",), ((r"(?s)^.*$", ""),), "imports", 0.95, True, "Remove unused import"),
    Rewrite("none-comparison", ("python",), ("none", "comparison"), ((r"== None", "is None"), (r"!= None", "is not None"), (r"== True", "is True"), (r"== False", "is False")), "correctness", 0.95, True, "Use 'is' for None/True/False comparisons"),
    Rewrite("bare-except", ("python",), ("bare except",), ((r"except:", "except Exception:"),), "correctness", 0.9, True, "Replace bare except with except Exception"),
    Rewrite("mutable-default", ("python",), ("mutable default",), ((r"=\[\]|=\{\}", "=None"),), "correctness", 0.7, False, "Replace mutable default argument with None"),
    Rewrite("f-string", ("python",), ("f-string", "format string"), ((r'"([^"{]*)\{\}([^"{]*)"\.format\((\w+)\)', r'f"$1{$3}$2"'), (r'"([^"%]*)%[sd]([^"%]*)"\s*%\s*(\w+)', r'f"$1{$3}$2"')), "style", 0.85, True, "Convert formatting to f-string"),
    Rewrite("var", _JS, ("'var'",), ((r"\bvar\b", "const"),), "style", 0.85, True, "Replace var with const"),
    Rewrite("equality", _JS, ("===",), ((r"(?<![=!])==(?!=)", "==="), (r"!=(?!=)", "!==")), "correctness", 0.9, True, "Use strict equality"),
    Rewrite("template", _JS, ("template literal",), ((r'"([^"]*)"\s*\+\s*(\w+)\s*\+\s*"([^"]*)"', r"`$1\${$2}$3`"),), "style", 0.85, True, "Use a template literal"),
    Rewrite("arrow", _JS, ("arrow function",), ((r"function\s*\(([^)]*)\)\s*\{", "($1) => {"),), "style", 0.75, False, "Use an arrow function"),
    Rewrite("optional-chaining", _JS, ("optional chaining",), ((r"(\w+)\s*&&\s*\1\.(\w+)", r"$1?.$2"),), "style", 0.85, True, "Use optional chaining"),
    Rewrite("nullish", _JS, ("nullish",), ((r"\|\|", "??"),), "correctness", 0.7, False, "Use ?? for defaults"),
)


def _applies(r: Rewrite) -> Column:
    said = F.lit(False)
    for w in r.words:
        said = said | F.contains(F.lower("message"), F.lit(w.lower()))
    return F.col("language").isin(*r.languages) & said


def propose_fixes(findings: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """``key, line_start, line_end, fix, category, confidence, safe, description, old_code, new_code`` where a rewrite changes something.

    ``findings`` has key, line_start, line_end, message; ``files`` key, language, content.
    """
    f = findings.select(key, "line_start", "line_end", "message").join(files.select(key, "language", "content"), key)
    old = F.array_join(F.slice(F.split("content", "\n", -1), F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n")
    f = f.select(key, "line_start", "line_end", "message", "language", old.alias("old_code"))
    chosen = None
    for r in REWRITES:
        new = F.col("old_code")
        for pattern, to in r.steps:
            new = F.regexp_replace(new, F.lit(pattern), F.lit(to))
        row = F.struct(F.lit(r.id).alias("fix"), F.lit(r.category).alias("category"), F.lit(r.confidence).alias("confidence"), F.lit(r.safe).alias("safe"), F.lit(r.description).alias("description"), new.alias("new_code"))
        chosen = F.when(_applies(r), row) if chosen is None else chosen.when(_applies(r), row)
    f = f.withColumn("_c", chosen).where("_c IS NOT NULL AND _c.new_code <> old_code")
    return f.select(key, "line_start", "line_end", "_c.fix", "_c.category", "_c.confidence", "_c.safe", "_c.description", "old_code", "_c.new_code")
