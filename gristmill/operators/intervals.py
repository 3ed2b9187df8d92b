"""Fixes as line intervals: filter, resolve conflicts, apply; and lines against changed ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_fixes(fixes: DataFrame, safe_only: bool = False, min_confidence: float = 0.0, categories: list[str] | None = None) -> DataFrame:
    if safe_only:
        fixes = fixes.where("safe")
    fixes = fixes.where(F.col("confidence") >= min_confidence)
    return fixes.where(F.col("category").isin(*categories)) if categories else fixes


def resolve_conflicts(fixes: DataFrame) -> DataFrame:
    """One fix of each cluster in a file: (file_path, ord, line_start, line_end, confidence).

    Fixes go by start and end. A cluster is an anchor and the fixes right after it that overlap the
    anchor itself (not each other); the surest stays, the first of equals; the next anchor follows the
    cluster. No cluster crosses a line that no fix covers: a file is cut there, and one sorted array an
    island is folded.
    """
    one = "struct<line_start:bigint,line_end:bigint,ord:bigint,confidence:double>"
    fold = f"""aggregate(items, struct(cast(null AS bigint) AS reach, cast(null AS {one}) AS best, cast(array() AS array<{one}>) AS done),
      (acc, x) -> CASE WHEN acc.reach IS NULL THEN struct(x.line_end AS reach, x AS best, acc.done AS done)
        WHEN x.line_start <= acc.reach THEN struct(acc.reach AS reach, CASE WHEN x.confidence > acc.best.confidence THEN x ELSE acc.best END AS best, acc.done AS done)
        ELSE struct(x.line_end AS reach, x AS best, concat(acc.done, array(acc.best)) AS done) END,
      acc -> CASE WHEN acc.best IS NULL THEN acc.done ELSE concat(acc.done, array(acc.best)) END)"""
    typed = fixes.select("file_path", *[F.col(c).cast("long") for c in ("line_start", "line_end", "ord")], F.col("confidence").cast("double"))
    before = Window.partitionBy("file_path").orderBy("line_start", "line_end", "ord")
    reach = F.max("line_end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    typed = typed.withColumn("_new", F.coalesce(F.col("line_start") > reach, F.lit(False)).cast("int"))
    typed = typed.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    items = typed.groupBy("file_path", "_island").agg(F.sort_array(F.collect_list(F.struct("line_start", "line_end", "ord", "confidence"))).alias("items"))
    return items.select("file_path", F.explode(F.expr(fold)).alias("k")).select("file_path", "k.*")


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``content`` of each file with its fixes (line_start, line_end, new_code) put in, from the bottom up."""
    todo = fixes.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line_start", "line_end", "new_code")), asc=False).alias("fixes"))
    put = """array_join(aggregate(coalesce(fixes, array()), split(content, '\\n', -1), (l, x) ->
      concat(slice(l, 1, cast(x.line_start - 1 AS int)), split(x.new_code, '\\n', -1), slice(l, cast(x.line_end + 1 AS int), greatest(size(l) - cast(x.line_end AS int), 0)))), '\\n')"""
    return files.join(todo, "file_path", "left").withColumn("content", F.expr(put)).drop("fixes")


def in_changed_lines(findings: DataFrame, hunks: DataFrame, context: int = 0) -> DataFrame:
    """Findings on lines within ``context`` of a changed range; those of files without ranges stay.

    Files are matched by equality and ranges inside the join, so no range is compared across files.
    """
    h = hunks.select(F.col("file_path").alias("_file"), (F.col("new_start") - context).alias("_from"), (F.col("new_start") + F.col("new_count") - 1 + context).alias("_to"))
    near = findings.join(h, (F.col("file_path") == F.col("_file")) & F.col("line_start").between(F.col("_from"), F.col("_to")), "left_semi")
    other = findings.join(h.select("_file").distinct(), F.col("file_path") == F.col("_file"), "left_anti")
    return near.unionByName(other)


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs: file_path, hunk, old_start, old_count, new_start, new_count, lines.

    ``diffs`` has file_path and diff (text). Lines before the first header belong to no hunk; a count
    that is not written is 1.
    """
    header = r"^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@"
    lines = diffs.select("file_path", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy("file_path").orderBy("pos")
    lines = lines.withColumn("hunk", F.sum(F.col("line").rlike(header).cast("int")).over(w)).where("hunk > 0")
    part = lambda k: F.max(F.when(F.col("line").rlike(header), F.regexp_extract("line", header, k)))
    number = lambda k, name: F.coalesce(F.nullif(part(k), F.lit("")), F.lit("1")).cast("long").alias(name)
    body = F.array_sort(F.collect_list(F.when(~F.col("line").rlike(header) & F.col("line").rlike("^[-+ ]"), F.struct("pos", "line"))))
    return lines.groupBy("file_path", "hunk").agg(number(1, "old_start"), number(2, "old_count"), number(3, "new_start"), number(4, "new_count"), F.transform(body, lambda x: x["line"]).alias("lines"))
