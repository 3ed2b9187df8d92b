"""Reports of any length, as files that together are one document.

A report is sections in order: a short text, or rows with a line each. Rows are dealt out by ranges of their
order and sorted, so each task writes a stretch of the document and no row, key or task holds it whole. Headings
and closing marks of groups are rows of their own, sorted before and after the group's items. The files'
names sort as their text goes: joined in that order they are the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity
from .sinks import _escaped, escape, sarif_results, sarif_rules


@dataclass
class Rows:
    """Lines of a section: ``frame`` with a column ``line`` and the columns of ``order``; ``between`` goes before each line but the first."""

    frame: DataFrame
    order: list[str]
    between: str = ""


def write_report(spark: SparkSession, path: str, sections: list[str | Rows], width: int | None = None) -> None:
    """Write a report under ``path``, in a folder for each section; a report that is there is replaced section by section."""
    for k, s in enumerate(sections):
        target = f"{path}/{k:03}"
        if isinstance(s, str):
            spark.createDataFrame([(s,)], "line string").coalesce(1).write.mode("overwrite").text(target)
            continue
        n = width or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        rows = s.frame.select(*s.order, "line").repartitionByRange(n, *s.order).sortWithinPartitions(*s.order, "line")
        # The first range holds the least row; its first row begins the section.
        line = F.when(F.monotonically_increasing_id() == 0, F.col("line")).otherwise(F.concat(F.lit(s.between), "line")) if s.between else F.col("line")
        rows.select(line.alias("line")).write.mode("overwrite").text(target)


def report_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a report in the order of their text."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "[0-9]*/part-*")) or []
    return sorted(f.getPath().toString() for f in found)


def _worst_first() -> Column:
    return (-severity.rank(unknown=-1)).alias("_rank")


_PLACE = ["file_path", "line_start", "message"]


def write_sarif(findings: DataFrame, path: str, tool: str = "gristmill", version: str = "1") -> None:
    """A SARIF document: every rule that has results, every finding by file and line."""
    spark = findings.sparkSession
    rules = sarif_rules(findings).select("id", F.col("rule").alias("line"))
    results = sarif_results(findings, tuple(_PLACE)).withColumnRenamed("result", "line")
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    write_report(spark, path, [head, Rows(rules, ["id"], ","), ']}},"results":[', Rows(results, _PLACE, ","), "]}]}"])


def write_json(findings: DataFrame, path: str) -> None:
    """``{"total": n, "findings": [...]}``, worst first; all columns of a finding but nulls."""
    total = findings.count()
    rows = findings.select(_worst_first(), *_PLACE, F.to_json(F.struct(*findings.columns)).alias("line"))
    write_report(findings.sparkSession, path, [f'{{"total":{total},"findings":[', Rows(rows, ["_rank", *_PLACE], ","), "]}"])


def _grouped(findings: DataFrame, group: list[Column], heading: Column, item: Column, closing: Column | None = None) -> DataFrame:
    """Rows of groups: heading, items by file and line, and closing; ``heading`` may use ``n``, the number of items."""
    names = [f"_g{k}" for k in range(len(group))]
    f = findings.select(*[g.alias(n) for g, n in zip(group, names, strict=True)], "*")
    items = f.select(*names, F.lit(1).alias("_part"), *_PLACE, item.alias("line"))
    ends = f.groupBy(*names).agg(F.count("*").alias("n"), F.first("severity").alias("severity"), F.min("file_path").alias("file_path"), F.count_if(F.col("severity").isin("critical", "high")).alias("bad"))
    none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in _PLACE]
    parts = [items.where("line IS NOT NULL"), ends.select(*names, F.lit(0).alias("_part"), *none, heading.alias("line"))]
    if closing is not None:
        parts.append(ends.select(*names, F.lit(2).alias("_part"), *none, closing.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(findings: DataFrame, path: str) -> None:
    """A section for each severity, worst first, with every finding."""
    line = F.concat(F.lit("- `"), "file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("` "), F.regexp_replace("message", r"\s*[\r\n]+\s*", " "))
    heading = F.concat(F.lit("\n## "), "severity", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"))
    rows = _grouped(findings, [-severity.rank(unknown=-1), F.col("severity")], heading, line)
    write_report(findings.sparkSession, path, ["# Findings", Rows(rows, ["_g0", "_g1", "_part", *_PLACE])])


def write_html(findings: DataFrame, path: str) -> None:
    """A page with a table for each severity, worst first, with every finding."""
    cells = [F.concat_ws(":", "file_path", F.col("line_start").cast("string")), F.col("message"), F.coalesce("suggestion", F.lit(""))]
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    heading = F.concat(F.lit('<h2 class="'), escape("severity"), F.lit('">'), escape("severity"), F.lit(": "), F.col("n").cast("string"), F.lit("</h2><table>"))
    rows = _grouped(findings, [-severity.rank(unknown=-1), F.col("severity")], heading, line, F.lit("</table>"))
    head = '<!DOCTYPE html><html><head><meta charset="utf-8"/><title>Findings</title></head><body>'
    write_report(findings.sparkSession, path, [head, Rows(rows, ["_g0", "_g1", "_part", *_PLACE]), "</body></html>"])


def write_junit(findings: DataFrame, path: str) -> None:
    """A test suite with a case for each file; critical and high findings are its failures."""
    total = findings.agg(F.countDistinct("file_path").alias("tests"), F.count_if(F.col("severity").isin("critical", "high")).alias("failures")).first()
    bad = F.col("severity").isin("critical", "high")
    line = F.when(bad, F.concat(F.lit('<failure type="'), escape("severity"), F.lit('" message="'), escape("message"), F.lit('">line '), F.col("line_start").cast("string"), F.lit("</failure>")))
    heading = F.concat(F.lit('<testcase name="'), escape("file_path"), F.lit('">'))
    rows = _grouped(findings, [F.col("file_path")], heading, line, F.lit("</testcase>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="gristmill" tests="{total["tests"]}" failures="{total["failures"] or 0}">'
    write_report(findings.sparkSession, path, [head, Rows(rows, ["_g0", "_part", *_PLACE]), "</testsuite>"])
