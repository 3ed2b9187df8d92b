"""Reports of many parts: joined they parse, and hold every finding in order."""

import json
import re
import xml.etree.ElementTree as ET
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.plans import tables
from gristmill.sources import reports

LEVELS = ["critical", "high", "medium", "low", "info", "unknown"]


def joined(spark, path):
    text = ""
    for f in reports.report_files(spark, path):
        with open(f.removeprefix("file:"), encoding="utf-8") as part:
            text += part.read()
    return text


@pytest.fixture(scope="module")
def found(spark):
    f = tables.findings(spark, "/root/testdata/sf0.01")
    return f.withColumn("message", F.when(F.col("ord") % 50 == 0, F.lit('<b> & "quoted"\nsecond line \\ é')).otherwise(F.col("message"))).cache()


def test_sarif_and_json(spark, found, tmp_path):
    reports.write_sarif(found, f"file://{tmp_path}/sarif")
    files = reports.report_files(spark, f"file://{tmp_path}/sarif")
    assert len(files) > 8  # many tasks wrote it
    run = json.loads(joined(spark, f"file://{tmp_path}/sarif"))["runs"][0]
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"], r["message"]["text"]) for r in run["results"]]
    assert places == sorted(places) and Counter(places) == Counter(map(tuple, found.select("file_path", "line_start", "message").collect()))
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in run["results"]})
    reports.write_json(found, f"file://{tmp_path}/json")
    whole = json.loads(joined(spark, f"file://{tmp_path}/json"))
    ranks = [LEVELS.index(x["severity"]) for x in whole["findings"]]
    assert whole["total"] == len(ranks) == found.count() and ranks == sorted(ranks)


def test_html_markdown_and_junit(spark, found, tmp_path):
    want = Counter(r[0] for r in found.select("severity").collect())
    reports.write_html(found, f"file://{tmp_path}/html")
    page = ET.fromstring(joined(spark, f"file://{tmp_path}/html").replace("<!DOCTYPE html>", ""))
    body = list(page.find("body"))
    assert [h.text for h in body if h.tag == "h2"] == [f"{x}: {want[x]}" for x in LEVELS if want[x]]
    assert [len(t) for t in body if t.tag == "table"] == [want[x] for x in LEVELS if want[x]]
    reports.write_markdown(found, f"file://{tmp_path}/md")
    md = joined(spark, f"file://{tmp_path}/md")
    sections = re.split(r"^## (\w+) \(\d+\)$", md, flags=re.M)[1:]
    assert {k: sum(x.startswith("- `") for x in v.split("\n")) for k, v in zip(sections[::2], sections[1::2], strict=True)} == dict(want)
    reports.write_junit(found, f"file://{tmp_path}/junit")
    suite = ET.fromstring(joined(spark, f"file://{tmp_path}/junit").encode())
    names = [c.get("name") for c in suite]
    assert names == sorted({r[0] for r in found.select("file_path").collect()}) and int(suite.get("failures")) == sum(len(c) for c in suite) == want["critical"] + want["high"]


def test_a_report_without_findings(spark, found, tmp_path):
    none = found.limit(0)
    for write in (reports.write_sarif, reports.write_json):
        write(none, f"file://{tmp_path}/{write.__name__}")
        json.loads(joined(spark, f"file://{tmp_path}/{write.__name__}"))
    reports.write_html(none, f"file://{tmp_path}/html")
    ET.fromstring(joined(spark, f"file://{tmp_path}/html").replace("<!DOCTYPE html>", ""))


def test_a_million_findings(spark, tmp_path):
    rows = spark.range(1_000_000).select(
        F.concat(F.lit("src/f"), (F.col("id") % 10).cast("string")).alias("file_path"), "id", F.col("id").alias("line_start"), F.col("id").alias("line_end"), F.lit("same").alias("message"), F.lit("high").alias("severity"),
        F.lit("t").alias("type"), F.lit(None).cast("string").alias("category"), F.lit(0.5).alias("confidence"),
    )
    reports.write_sarif(rows, f"file://{tmp_path}/sarif")
    count, text = 0, 0
    for f in reports.report_files(spark, f"file://{tmp_path}/sarif"):
        with open(f.removeprefix("file:"), encoding="utf-8") as part:
            lines = part.read().split("\n")
            count += sum('"ruleId"' in x for x in lines)
            text = max(text, sum(map(len, lines)))
    assert count == 1_000_000 and text < 100_000_000
