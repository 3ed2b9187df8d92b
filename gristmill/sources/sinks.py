"""Reports made of findings: SARIF, JUnit, Markdown, HTML, pull-request comments, messages for chat, mail and CI."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity
from ..operators.findings import cap, fingerprint, priority


def _result():
    """A finding as a SARIF result, in JSON."""
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.coalesce("category", "type").alias("ruleId"), severity.case("severity", severity.SARIF_LEVELS, "note").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(fingerprint().alias("primary")).alias("partialFingerprints"), F.struct(severity.case("severity", severity.SARIF_SCORES, "1.0").alias("security-severity"), "confidence").alias("properties"),
    )
    return F.to_json(result)


def sarif_results(findings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text for each result, with rule, level, place and fingerprint, beside the columns of ``keep``."""
    return findings.select(*keep, _result().alias("result"))


def junit_cases(findings: DataFrame) -> DataFrame:
    """One row a file: tests, failures (critical and high) and the test case as XML."""
    bad = F.col("severity").isin("critical", "high")
    text = F.when(bad, F.concat(F.lit('<failure type="'), F.col("severity"), F.lit('">'), escape("message"), F.lit("</failure>")))
    g = findings.groupBy("file_path").agg(F.count("*").alias("tests"), F.count_if(bad).alias("failures"), F.array_sort(F.collect_list(F.when(bad, F.struct("line_start", text.alias("x"))))).alias("_f"))
    xml = F.concat(F.lit('<testcase name="'), escape("file_path"), F.lit('">'), F.array_join(F.transform("_f", lambda r: r["x"]), ""), F.lit("</testcase>"))
    return g.withColumn("testcase", xml).drop("_f")


def escape(column: str):
    """Text for XML and HTML."""
    return _escaped(F.col(column))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown(findings: DataFrame) -> DataFrame:
    """One row a severity: the section of a Markdown report."""
    line = F.concat(F.lit("- `"), F.col("file_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("` "), F.col("message"))
    g = findings.groupBy("severity").agg(F.count("*").alias("findings"), F.array_sort(F.collect_set(F.struct("file_path", "line_start", line.alias("line")))).alias("_l"))
    return g.select("severity", "findings", F.concat(F.lit("## "), F.col("severity"), F.lit("\n"), F.array_join(F.transform("_l", lambda r: r["line"]), "\n")).alias("section"))


def pr_comment(findings: DataFrame, keys: list[str], order: list, most: int = 50) -> DataFrame:
    """One row a review: the badge of its worst severity, and at most ``most`` findings, worst first."""
    worst = F.max(severity.rank(unknown=-1))
    badge = F.when(worst >= 4, "blocked").when(worst == 3, "needs work").when(worst >= 1, "comments").otherwise("clean")
    head = findings.groupBy(*keys).agg(badge.alias("badge"), F.count("*").alias("findings"))
    top = cap(findings, keys, most, [F.desc(severity.rank(unknown=-1)), *order])
    shown = top.groupBy(*keys).agg(F.count("*").alias("shown"))
    return head.join(shown, keys)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One JSON text for each rule that has results: its id, worst level and highest score."""
    rank = F.max(severity.rank(unknown=-1))
    g = findings.groupBy(F.coalesce("category", "type").alias("id")).agg(rank.alias("_r"), F.count("*").alias("results"))
    names = F.element_at(F.array(*[F.lit(x) for x in severity.LEVELS]), (F.greatest("_r", F.lit(0)) + 1).cast("int"))
    worst = F.when(F.col("_r") >= 0, names)
    rule = F.struct("id", F.col("id").alias("name"), F.struct(severity.case(worst, severity.SARIF_LEVELS, "note").alias("level")).alias("defaultConfiguration"), F.struct(severity.case(worst, severity.SARIF_SCORES, "1.0").alias("security-severity")).alias("properties"))
    return g.select("id", "results", F.to_json(rule).alias("rule"))


def sarif_documents(findings: DataFrame, key: str, tool: str = "gristmill", version: str = "1") -> DataFrame:
    """``key, document``: a whole SARIF document for each value of ``key`` (a review or a project).

    A document gathers its own results in one row; a key is a unit that somebody uploads as one file.
    """
    one = findings.select(key, F.coalesce("category", "type").alias("_rule"), "file_path", "line_start", _result().alias("_json"))
    g = one.groupBy(key).agg(F.array_sort(F.collect_set("_rule")).alias("_rules"), F.array_sort(F.collect_list(F.struct("file_path", "line_start", "_json"))).alias("_all"))
    rules = F.transform("_rules", lambda r: F.to_json(F.struct(r.alias("id"))))
    text = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","version":"' + version + '","rules":['), F.array_join(rules, ","),
        F.lit(']}},"results":['), F.array_join(F.transform("_all", lambda r: r["_json"]), ","), F.lit("]}]}"),
    )
    return g.select(key, F.size("_all").cast("long").alias("results"), F.size("_rules").cast("long").alias("rules"), text.alias("document"))


def html_report(findings: DataFrame, keys: list[str], order: list, most: int = 50) -> DataFrame:
    """``keys, findings, shown, html``: counts by severity and the ``most`` findings of highest priority."""
    scored = priority(findings)
    head = findings.groupBy(*keys).agg(F.count("*").alias("findings"), *severity.counts())
    top = cap(scored, keys, most, [F.desc("priority_score"), *order])
    cells = [F.col("severity"), F.concat_ws(":", "file_path", F.col("line_start").cast("string")), F.col("message"), F.coalesce("suggestion", F.lit(""))]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    rows = top.select(*keys, F.struct((-F.col("priority_score")).alias("p"), *order, row.alias("row")).alias("r"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("_r"))
    counted = F.concat(F.lit("<ul>"), *[F.concat(F.lit(f'<li class="{x}">{x}: '), F.col(x).cast("string"), F.lit("</li>")) for x in reversed(severity.LEVELS)], F.lit("</ul>"))
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Findings</title></head><body>'), counted, F.lit("<table>"), F.array_join(F.transform("_r", lambda r: r["row"]), ""), F.lit("</table></body></html>"))
    return head.join(rows, keys).select(*keys, "findings", F.size("_r").cast("long").alias("shown"), page.alias("html"))


#: How many findings a message shows, by service.
SHOWN = {"chat": 5, "mail": 20, "ci": 50}


def messages(findings: DataFrame, keys: list[str], order: list, service: str = "chat") -> DataFrame:
    """``keys, status, payload``: what is posted to a service, as JSON; sending it is the caller's.

    ``status`` is the worst of critical, high, medium that occurs, else ``clean``. The payload has the
    counts by severity and the service's number of findings, worst first, then by ``order``, place and
    text, so that reruns agree.
    """
    c = findings.groupBy(*keys).agg(F.count("*").alias("total"), *severity.counts())
    status = F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("clean")
    item = F.struct("severity", F.concat_ws(":", "file_path", F.col("line_start").cast("string")).alias("place"), "message")
    order = [*order, "file_path", "line_start", "severity", "message"]
    top = cap(findings, keys, SHOWN[service], [F.desc(severity.rank(unknown=-1)), *order])
    top = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-severity.rank(unknown=-1)).alias("r"), *order, item.alias("x")))).alias("_t"))
    both = c.join(top, keys)
    payload = F.to_json(F.struct(status.alias("status"), "total", F.struct(*severity.LEVELS).alias("counts"), F.transform("_t", lambda t: t["x"]).alias("findings")))
    return both.select(*keys, status.alias("status"), payload.alias("payload"))
