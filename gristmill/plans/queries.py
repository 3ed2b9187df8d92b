"""Queries over the engine's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex, severity
from ..operators import chunks, clones, dashboard, findings, intervals, learning, policy, rules, supply
from . import samples, tables
from .tables import CTE, LEVEL_COUNTS
from .weaknesses import WEAKNESSES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORDER = ("ord", "tie", "confidence", "suggestion")
HOURS = "CASE severity WHEN 'critical' THEN 8.0 WHEN 'high' THEN 4.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 WHEN 'info' THEN 0.5 ELSE 0.0 END"
WEIGHTS = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0.5 END"


def query(sql: str | None = None):
    """Register a function as the query of its name; ``sql`` selects from the tables in ``CTE``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {CTE} {sql}" if not sql.lstrip().startswith(",") else f"WITH {CTE}{sql}"
        return f

    return add


def _crypto_rule() -> str:
    # The default rule's word bound, spelt out so that every engine reads it alike.
    return r"(?:^|[^A-Za-z0-9_])(?:[Mm][Dd]5|[Ss][Hh][Aa]1|[Dd][Ee][Ss])(?:$|[^A-Za-z0-9_])"


@query(f"""SELECT lang, CAST(sum(crypto) AS BIGINT) AS crypto, CAST(sum(secret) AS BIGINT) AS secrets, count(*) FILTER (crypto > 0 OR secret > 0) AS files_hit, count(*) AS files FROM (
  SELECT lang, len(regexp_extract_all(content, '{_crypto_rule()}')) AS crypto, len(regexp_extract_all(content, '(?i)(?:api[_-]?key|password|secret|token)[ \\t]*[=:][ \\t]*["''][A-Za-z0-9_-]{{20,}}["'']')) AS secret FROM files) GROUP BY lang""")
def flagship_rule_severity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    secret = r"""(?i)(?:api[_-]?key|password|secret|token)[ \t]*[=:][ \t]*["'][A-Za-z0-9_-]{20,}["']"""
    f = f.select("lang", regex.count("content", _crypto_rule()).alias("crypto"), regex.count("content", secret).alias("secret"))
    return f.groupBy("lang").agg(F.sum("crypto").cast("long").alias("crypto"), F.sum("secret").cast("long").alias("secrets"), F.count_if((F.col("crypto") > 0) | (F.col("secret") > 0)).alias("files_hit"), F.count("*").alias("files"))


@query("SELECT file_path, language, content IS NOT NULL AS readable FROM files WHERE length(content) <= 20000 AND NOT (file_path LIKE '%/src1/%')")
def s1_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import scan_predicate

    f = tables.files(spark, sf_dir)
    return f.where(scan_predicate("file_path", F.length("content"), exclude=["src1"], max_size=20000)).select("file_path", "language", F.col("content").isNotNull().alias("readable"))


@query("SELECT file_path, (file_path LIKE 'src/mod1%' OR file_path LIKE '%.py') AS matched FROM (SELECT DISTINCT file_path FROM findings)")
def s2_glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).select("file_path").distinct()
    return f.select("file_path", regex.glob_any_part("file_path", ["src/mod1*", "*.py"]).alias("matched"))


@query("SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.js' THEN 'javascript' ELSE 'go' END AS language FROM (SELECT DISTINCT file_path FROM findings)")
def s3_language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import language

    f = tables.findings(spark, sf_dir).select("file_path").distinct()
    return f.select("file_path", language("file_path").alias("language"))


_RULE_VALUES = ", ".join(f"('{r.id}', '{r.severity}', {list(r.languages) if r.languages else 'NULL::VARCHAR[]'})" for r in rules.DEFAULT_RULES)


@query(f"SELECT id, v.severity, count(*) AS files FROM (VALUES {_RULE_VALUES}) v(id, severity, languages) JOIN files f ON v.languages IS NULL OR list_contains(v.languages, f.language) GROUP BY id, v.severity")
def s5_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each default rule is for."""
    f = tables.files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"))
    r = rules.RulesEngine().table(spark).where("enabled").withColumn("language", F.explode_outer("languages"))
    some = r.where("languages IS NOT NULL").join(f, "language").groupBy("id", "severity").agg(F.sum("files").alias("files"))
    whole = f.agg(F.sum("files").alias("files")).first()["files"]
    return some.unionByName(r.where("languages IS NULL").select("id", "severity", F.lit(whole).cast("long").alias("files")))


@query(f"SELECT review_id, count(*) AS total_findings, {LEVEL_COUNTS} FROM findings GROUP BY review_id")
def s6_upload_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded reviews are nested rows: they are built here and taken apart again by the upload source."""
    from ..sources.uploads import findings_of

    f = tables.findings(spark, sf_dir)
    nested = f.groupBy("review_id").agg(F.collect_list(F.struct("type", "severity", "category", F.col("file_path").alias("file"), F.col("line_start").alias("line"), "line_end", "message", "suggestion", "confidence")).alias("findings"))
    return findings_of(nested, ["review_id"]).groupBy("review_id").agg(F.count("*").alias("total_findings"), *severity.counts())


@query("SELECT 'lib-' || CAST(l_partkey % 50 AS VARCHAR) AS name, CAST(l_suppkey % 9 AS VARCHAR) || '.1' AS version, count(*) AS files FROM lineitem GROUP BY 1, 2")
def s8_all_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all rows."""
    return _manifest_files(tables.table(spark, sf_dir, "lineitem"))


def _manifest_files(li: DataFrame) -> DataFrame:
    content = F.concat(F.lit("# pinned\n"), F.lit("lib-"), (F.col("l_partkey") % 50).cast("string"), F.lit("=="), (F.col("l_suppkey") % 9).cast("string"), F.lit(".1\n-r other.txt\n"))
    m = li.select(F.concat(F.lit("app/"), F.monotonically_increasing_id().cast("string"), F.lit("/requirements.txt")).alias("file_path"), content.alias("content"))
    return supply.dependencies(m).groupBy("name", "version").agg(F.count("*").alias("files"))


@query("SELECT 'f' || CAST(o_custkey AS VARCHAR) AS file_path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS hunk, o_orderkey % 1000 + 1 AS new_start, CAST(2 AS BIGINT) AS new_count, CAST(3 AS BIGINT) AS n_lines FROM orders")
def s10_diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    hunk = F.concat(F.lit("@@ -"), (F.col("o_orderkey") % 1000 + 1).cast("string"), F.lit(",1 +"), (F.col("o_orderkey") % 1000 + 1).cast("string"), F.lit(",2 @@ fn\n-old\n+new\n+more"))
    d = o.groupBy(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("file_path")).agg(F.concat(F.lit("--- a/f\n+++ b/f\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", hunk.alias("h")))), lambda x: x["h"]), "\n")).alias("diff"))
    return intervals.parse_diffs(d).select("file_path", F.col("hunk").cast("long").alias("hunk"), "new_start", "new_count", F.size("lines").cast("long").alias("n_lines"))


@query("SELECT sha256(coalesce(md5(content), '') || ':perf,security:local:none') AS key, count(*) AS files, doc_hit AS hit FROM (SELECT content, lang = 'en' AS doc_hit FROM files) GROUP BY 1, 3")
def s13_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.cache import cache_key, split_by_cache

    f = tables.files(spark, sf_dir).withColumn("key", cache_key(F.md5("content"), ["security", "perf"], "local", "none"))
    cached = f.where("lang = 'en'").select("key", "lang").distinct()
    hits, misses = split_by_cache(f, cached.withColumnRenamed("lang", "lang2"), ["key"], same={"lang": "lang2"})
    both = hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))
    return both.groupBy("key", "hit").agg(F.count("*").alias("files"))


@query("SELECT review_id, ord, severity, confidence FROM findings WHERE review_id % 50 >= 0")
def s14_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model: fenced JSON, parsed to findings; a missing confidence counts as 1."""
    from ..sources.responses import parse_findings

    f = tables.findings(spark, sf_dir)
    answer = F.concat(F.lit("```json\n["), F.to_json(F.struct("severity", "message", "confidence")), F.lit("]\n```"))
    r = f.select("review_id", "ord", answer.alias("answer"))
    return parse_findings(r, "answer", ["review_id", "ord"]).select("review_id", "ord", "severity", "confidence")


@query("SELECT p_name AS name, s_name AS supplier, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_name, s_name")
def s15_all_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dependencies, with advisories on all parts."""
    return _enriched(spark, sf_dir, "true")


def _enriched(spark: SparkSession, sf_dir: str, parts: str) -> DataFrame:
    """Uses of each part and supplier, with an advisory on each version of the ``parts`` that are supplied."""
    li, p, s = (tables.table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    ids = [F.col("l_partkey").cast("string").alias("name"), F.lit("parts").alias("ecosystem"), F.col("l_suppkey").cast("string").alias("version")]
    deps = li.select(*ids).groupBy("name", "ecosystem", "version").agg(F.count("*").alias("uses"))
    names = p.where(parts).select(F.col("p_partkey").cast("string").alias("name"), "p_name")
    supplied = li.select(*ids).distinct().join(names, "name").join(s.select(F.col("s_suppkey").cast("string").alias("version"), "s_name"), "version")
    found = supply.with_advisories(deps, supplied)
    return found.groupBy(F.col("p_name").alias("name"), F.col("s_name").alias("supplier")).agg(F.sum("uses").alias("uses"))


@query("""SELECT substring(md5(file_path || ':' || CAST(line_start AS VARCHAR) || ':' || message), 1, 16) AS fingerprint, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS results FROM findings GROUP BY 1, 2""")
def k1_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    return f.groupBy(findings.fingerprint().alias("fingerprint"), severity.case("severity", severity.SARIF_LEVELS, "note").alias("level")).agg(F.count("*").alias("results"))


@query("SELECT file_path, count(*) AS tests, count(*) FILTER (severity IN ('critical', 'high')) AS failures FROM findings GROUP BY file_path")
def k2_junit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import junit_cases

    return junit_cases(tables.findings(spark, sf_dir)).select("file_path", "tests", "failures")


@query("SELECT review_id, ord, tie, severity, file_path FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY coalesce(rnk, -1) DESC, ord, tie, confidence, suggestion) AS n FROM ranked) WHERE n <= 3")
def k4_pr_comment_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.cap(tables.findings(spark, sf_dir), ["review_id"], 3, [F.desc(severity.rank(unknown=-1)), *ORDER])
    return f.select("review_id", "ord", "tie", "severity", "file_path")


@query("SELECT critical, high, CASE WHEN critical > 0 OR high > 5 THEN 'FAILURE' ELSE 'SUCCESS' END AS state FROM (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM findings)")
def k6_ci_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ci_status(tables.findings(spark, sf_dir))


@query("SELECT review_id, ord, tie, severity, file_path, confidence FROM ranked WHERE rnk >= 2 AND rnk <= 3 AND confidence >= 0.7 AND (category IN ('security', 'performance') OR type IN ('security', 'performance')) AND file_path LIKE 'src/mod1%.py'")
def p1_filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.filter_findings(tables.findings(spark, sf_dir), "medium", "high", 0.7, ["security", "performance"], ["src/mod1*.py"])
    return f.select("review_id", "ord", "tie", "severity", "file_path", "confidence")


@query("SELECT severity, count(*) AS findings FROM ranked WHERE coalesce(rnk, 99) >= 2 GROUP BY severity")
def p2_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.at_least(tables.findings(spark, sf_dir), "medium").groupBy("severity").agg(F.count("*").alias("findings"))


@query("SELECT source, count(*) AS findings FROM findings WHERE source <> 'llm' OR confidence >= 0.75 GROUP BY source")
def p3_llm_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.confident(tables.findings(spark, sf_dir), 0.75).groupBy("source").agg(F.count("*").alias("findings"))


@query("SELECT review_id, ord, tie FROM findings WHERE (file_path, line_start) IN (SELECT file_path, line_start FROM findings WHERE severity = 'critical')")
def p5_accepted_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    decisions = f.select("file_path", "line_start", F.when(F.col("severity") == "critical", "accept").otherwise("reject").alias("decision"))
    return findings.accepted_only(f, decisions).select("review_id", "ord", "tie")


@query("SELECT ord, tie, line_start, line_end FROM findings WHERE suggestion = 'fix it' AND confidence >= 0.8 AND category IN ('security')")
def p6_filter_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).withColumn("safe", F.col("suggestion") == "fix it")
    return intervals.filter_fixes(f, True, 0.8, ["security"]).select("ord", "tie", "line_start", "line_end")


@query("SELECT review_id, project_id, status FROM reviews WHERE status = 'O' ORDER BY started_at DESC, review_id LIMIT 50 OFFSET 100")
def p7_review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.reviews(spark, sf_dir).where("status = 'O'")
    return dashboard.page(r, [F.desc("started_at"), "review_id"], 100, 50).select("review_id", "project_id", "status")


@query(""", hunks AS (SELECT DISTINCT file_path, line_start - line_start % 10 AS new_start, CAST(3 AS BIGINT) AS new_count FROM findings WHERE severity = 'critical')
SELECT ord, tie FROM findings f WHERE NOT EXISTS (SELECT 1 FROM hunks h WHERE h.file_path = f.file_path) OR EXISTS (SELECT 1 FROM hunks h WHERE h.file_path = f.file_path AND f.line_start BETWEEN new_start - 1 AND new_start + new_count)""")
def p8_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    h = f.where("severity = 'critical'").select("file_path", (F.col("line_start") - F.col("line_start") % 10).alias("new_start"), F.lit(3).cast("long").alias("new_count")).distinct()
    return intervals.in_changed_lines(f, h, 1).select("ord", "tie")


@query("SELECT item_id, CASE WHEN priority = 'low' THEN 'resolved' ELSE status END AS status, priority = 'low' AND status <> 'resolved' AS resolved_now FROM debt_items")
def p10_update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.debt_items(spark, sf_dir)
    done = F.col("priority") == "low"
    return d.select("item_id", F.when(done, "resolved").otherwise(F.col("status")).alias("status"), (done & (F.col("status") != "resolved")).alias("resolved_now"))


@query(f"SELECT p.project_id, p.name, count(*) AS findings, {LEVEL_COUNTS} FROM projects p JOIN reviews r USING (project_id) JOIN findings f USING (review_id) GROUP BY p.project_id, p.name")
def j1_project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r, p = tables.findings(spark, sf_dir), tables.reviews(spark, sf_dir), tables.projects(spark, sf_dir)
    return p.join(r, "project_id").join(f, "review_id").groupBy("project_id", "name").agg(F.count("*").alias("findings"), *severity.counts())


@query("SELECT item_id, d.priority, f.findings FROM debt_items d LEFT JOIN (SELECT line_start, count(*) AS findings FROM findings GROUP BY line_start) f ON d.item_id = f.line_start")
def j12_debt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).groupBy(F.col("line_start").alias("item_id")).agg(F.count("*").alias("findings"))
    return tables.debt_items(spark, sf_dir).join(f, "item_id", "left").select("item_id", "priority", "findings")


@query(f"SELECT {LEVEL_COUNTS} FROM findings")
def a1_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_severity(tables.findings(spark, sf_dir))


@query("SELECT kind, count(*) AS findings FROM ranked GROUP BY kind")
def a2_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_category(tables.findings(spark, sf_dir))


@query("SELECT file_path, count(*) AS findings, min(line_start) AS first_line, max(line_start) AS last_line FROM findings GROUP BY file_path")
def a2_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_file(tables.findings(spark, sf_dir)).select("file_path", "findings", F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"))


@query(f"SELECT count(*) AS total, {LEVEL_COUNTS}, count(*) FILTER (severity IN ('critical', 'high') AND confidence >= 0.8) AS high_confidence_critical, count(*) FILTER (suggestion <> '') AS actionable, count(DISTINCT file_path) AS files, coalesce(bool_or(severity IN ('critical', 'high')), FALSE) AS has_critical FROM findings")
def a3_quick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(tables.findings(spark, sf_dir))


@query("SELECT review_id, bool_or(severity IN ('critical', 'high')) AS has_critical FROM findings GROUP BY review_id")
def a4_has_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.findings(spark, sf_dir).groupBy("review_id").agg(F.bool_or(F.col("severity").isin("critical", "high")).alias("has_critical"))


@query("""SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM reviews) AS reviews, CAST(sum(n) AS BIGINT) AS findings, round(avg(n), 6) AS avg_findings, CAST(sum(c) AS BIGINT) AS critical, CAST(sum(h) AS BIGINT) AS high
FROM (SELECT count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM findings GROUP BY review_id)""")
def a5_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.findings(spark, sf_dir).groupBy("review_id").agg(F.count("*").alias("total_findings"), *severity.counts())
    o = dashboard.overview(tables.projects(spark, sf_dir), tables.reviews(spark, sf_dir), c)
    return o.withColumn("avg_findings", F.round("avg_findings", 6))


@query(f"SELECT review_id, CAST(sum({HOURS}) AS DOUBLE) AS debt_hours FROM findings GROUP BY review_id")
def a6_debt_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.findings(spark, sf_dir).groupBy("review_id").agg(dashboard.debt_hours().alias("debt_hours"))


@query(f"SELECT review_id, round(greatest(0.0, 100.0 - 10.0 * CAST(sum({WEIGHTS}) AS DOUBLE) / count(DISTINCT file_path)), 1) AS quality_score FROM findings GROUP BY review_id")
def a7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.findings(spark, sf_dir).groupBy("review_id").agg(severity.weighted(severity.SCORE_WEIGHTS, 0.5).alias("w"), F.countDistinct("file_path").alias("n"))
    return q.select("review_id", F.round(F.greatest(F.lit(0.0), 100.0 - 10.0 * F.col("w") / F.col("n")), 1).alias("quality_score"))


@query("SELECT review_id, greatest(0, 100 - (10 * count(*) FILTER (severity = 'critical') + 5 * count(*) FILTER (severity = 'high') + 2 * count(*) FILTER (severity = 'medium'))) AS score FROM findings GROUP BY review_id")
def a8_review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.findings(spark, sf_dir).groupBy("review_id").agg(*severity.counts())
    return c.select("review_id", dashboard.review_score(F.col("critical"), F.col("high"), F.col("medium")).cast("long").alias("score"))


@query("SELECT file_path, CAST(sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS BIGINT) AS risk FROM findings GROUP BY file_path")
def a9_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.findings(spark, sf_dir).groupBy("file_path").agg(dashboard.risk_score().cast("long").alias("risk"))


@query("""SELECT author, count(*) AS reviews, CAST(sum(n) AS BIGINT) AS introduced, round(avg(n), 6) AS quality FROM reviews JOIN (SELECT review_id, count(*) AS n FROM findings GROUP BY review_id) USING (review_id)
WHERE started_at >= TIMESTAMP '1994-01-01' AND started_at <= TIMESTAMP '1997-12-31' GROUP BY author""")
def a10_team_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.findings(spark, sf_dir).groupBy("review_id").agg(F.count("*").alias("introduced"))
    m = tables.reviews(spark, sf_dir).join(n, "review_id").select("author", F.col("started_at").alias("period_start"), F.col("started_at").alias("period_end"), F.lit(1).alias("reviews"), "introduced", *[F.lit(0).alias(c) for c in ("fixed", "lines_added", "lines_removed")], F.col("introduced").cast("double").alias("quality"))
    t = dashboard.team_metrics(m, F.to_timestamp_ntz(F.lit("1994-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1997-12-31 00:00:00")))
    return t.select("author", "reviews", "introduced", F.round("quality", 6).alias("quality"))


@query("""SELECT count(*) AS total, count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low,
count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'resolved') AS resolved, sum(estimated_hours) AS hours FROM debt_items""")
def a11_debt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.debt_summary(tables.debt_items(spark, sf_dir))


@query("""SELECT r.project_id, r.review_id, coalesce(f.n, 0) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, review_id DESC) AS k FROM reviews) r
LEFT JOIN (SELECT review_id, count(*) AS n FROM findings GROUP BY review_id) f USING (review_id) WHERE k = 1""")
def a12_latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = dashboard.latest(tables.reviews(spark, sf_dir), "project_id", "started_at", "review_id")
    n = tables.findings(spark, sf_dir).groupBy("review_id").agg(F.count("*").alias("findings"))
    return last.join(n, "review_id", "left").select("project_id", "review_id", F.coalesce("findings", F.lit(0)).alias("findings"))


@query(""", s AS (SELECT project_id, date_trunc('month', started_at) AS m, count(*) AS n FROM reviews GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY m) - 1 AS i FROM s),
g AS (SELECT project_id, count(*) AS points, coalesce(regr_slope(CAST(n AS DOUBLE), CAST(i AS DOUBLE)), 0.0) AS slope, min_by(n, i) AS first, max_by(n, i) AS last FROM i GROUP BY project_id)
SELECT project_id, points, first, last, CASE WHEN points < 2 THEN 'stable' WHEN slope < -0.1 THEN 'improving' WHEN slope > 0.1 THEN 'declining' ELSE 'stable' END AS direction, round(CASE WHEN points < 2 OR first = 0 THEN 0.0 ELSE CAST(first - last AS DOUBLE) / first * 100.0 END, 4) AS improvement_rate FROM g""")
def a13_a14_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.reviews(spark, sf_dir).groupBy("project_id", F.date_trunc("month", "started_at").alias("m")).agg(F.count("*").alias("n"))
    t = dashboard.trend(s, "project_id", ["m"], "n")
    return t.select("project_id", "points", "first", "last", "direction", F.round("improvement_rate", 4).alias("improvement_rate"))


@query("SELECT project_id, strftime(started_at, '%Y-%m-%d') AS day, count(*) AS reviews FROM reviews WHERE started_at >= TIMESTAMP '1995-01-01' GROUP BY 1, 2")
def a16_project_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.reviews(spark, sf_dir).where("started_at >= timestamp_ntz '1995-01-01 00:00:00'")
    return r.groupBy("project_id", F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("reviews"))


RATES = "count(*) AS total, count(*) FILTER (feedback_type = 'accept') AS accept, count(*) FILTER (feedback_type = 'reject') AS reject, count(*) FILTER (feedback_type = 'modify') AS modify, count(*) FILTER (feedback_type = 'skip') AS skip, round(CAST(count(*) FILTER (feedback_type = 'accept') AS DOUBLE) / count(*), 6) AS accept_rate, round(CAST(count(*) FILTER (feedback_type = 'reject') AS DOUBLE) / count(*), 6) AS reject_rate"


@query(f"SELECT rule_id, {RATES} FROM feedback GROUP BY rule_id")
def a17_feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = learning.feedback_stats(tables.feedback(spark, sf_dir), "rule_id")
    return s.withColumn("accept_rate", F.round("accept_rate", 6)).withColumn("reject_rate", F.round("reject_rate", 6))


@query("SELECT rule_id, total, rejects FROM (SELECT rule_id, count(*) AS total, count(*) FILTER (feedback_type = 'reject') AS rejects FROM feedback GROUP BY rule_id) WHERE 10 * rejects >= 4 * total")
def a18_false_positive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.false_positive_rules(tables.feedback(spark, sf_dir), 0.4).select("rule_id", "total", "rejects")


ADJUST = """, m AS (SELECT rule_id, severity, row_number() OVER (PARTITION BY rule_id ORDER BY count(*) DESC, severity) AS k FROM feedback GROUP BY rule_id, severity),
s AS (SELECT rule_id, count(*) AS total, CAST(count(*) FILTER (feedback_type = 'accept') AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (feedback_type = 'reject') AS DOUBLE) / count(*) AS r FROM feedback GROUP BY rule_id HAVING count(*) >= 5),
adj AS (SELECT rule_id, total, a, r, r >= 0.6 AS suppress, severity AS original_severity,
  CASE WHEN a < 0.3 THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'info' END WHEN a > 0.8 THEN CASE severity WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END ELSE severity END AS adjusted_severity,
  CASE WHEN a > 0.8 THEN 1.2 WHEN r >= 0.5 THEN 0.7 ELSE 1.0 END AS multiplier FROM s JOIN m USING (rule_id) WHERE k = 1)"""


@query(ADJUST + "SELECT rule_id, total, suppress, original_severity, adjusted_severity, CAST(multiplier AS DOUBLE) AS multiplier FROM adj")
def a19_rule_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.rule_adjustments(tables.feedback(spark, sf_dir)).select("rule_id", "total", "suppress", "original_severity", "adjusted_severity", "multiplier")


@query(ADJUST + "SELECT rule_id, total, suppress, original_severity, adjusted_severity, CAST(multiplier AS DOUBLE) AS multiplier FROM adj")
def a19_streamed_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that takes the feedback in several batches."""
    from ..sources.workdir import work_dir
    from ..streaming import adjustments

    root, f = work_dir(spark, "feedback"), tables.feedback(spark, sf_dir).select("rule_id", "severity", "feedback_type")
    f.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run = adjustments.start(stream, f"{root}/out", f"{root}/checkpoint")
    run.awaitTermination()
    return adjustments.adjustments_table(spark, f"{root}/out").read().select("rule_id", "total", "suppress", "original_severity", "adjusted_severity", "multiplier")


@query(ADJUST + "SELECT coalesce(a.adjusted_severity, f.severity) AS severity, count(*) AS findings, round(sum(least(100.0, f.confidence * coalesce(CAST(a.multiplier AS DOUBLE), 1.0))), 2) AS confidence FROM findings f LEFT JOIN adj a USING (rule_id) WHERE NOT coalesce(a.suppress, FALSE) GROUP BY 1")
def a20_apply_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = learning.apply_learning(tables.findings(spark, sf_dir), learning.rule_adjustments(tables.feedback(spark, sf_dir)))
    return f.groupBy("severity").agg(F.count("*").alias("findings"), F.round(F.sum("confidence"), 2).alias("confidence"))


@query(ADJUST + "SELECT rule_id, 'review-or-disable' AS advice, round(r, 6) AS rate FROM adj WHERE r >= 0.5 UNION ALL SELECT rule_id, 'lower-severity', round(a, 6) FROM adj WHERE a < 0.3")
def a21_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = learning.recommendations(learning.rule_adjustments(tables.feedback(spark, sf_dir)))
    return r.withColumn("rate", F.round("rate", 6))


LICENSE_CASE = "CASE WHEN contains(t, 'mit license') THEN 'MIT' WHEN contains(t, 'apache license') AND contains(t, 'version 2.0') THEN 'Apache-2.0' WHEN contains(t, 'gnu general public license') AND contains(t, 'version 3') THEN 'GPL-3.0' WHEN contains(t, 'gnu general public license') AND contains(t, 'version 2') THEN 'GPL-2.0' WHEN contains(t, 'unlicense') THEN 'Unlicense' END"


@query(f"SELECT coalesce(spdx, 'none') AS spdx, count(*) AS files, count(*) FILTER (spdx = 'GPL-3.0') AS violations FROM (SELECT {LICENSE_CASE} AS spdx FROM (SELECT lower(content) AS t FROM files)) GROUP BY 1")
def a22_license_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir).select(supply.license_id(F.col("content")).alias("spdx"))
    risk = supply.license_risk(F.col("spdx"), supply.license_category(F.col("spdx")), denied_categories=("strong_copyleft",))
    return f.groupBy(F.coalesce("spdx", F.lit("none")).alias("spdx")).agg(F.count("*").alias("files"), F.count_if(F.coalesce(risk.isin("critical", "high"), F.lit(False))).alias("violations"))


@query("SELECT s_nationkey AS nation, count(*) AS deps, round(greatest(0.0, 100.0 - 20.0 * count(*) FILTER (s_acctbal < 0) / count(*) - 40.0 * count(*) FILTER (s_suppkey % 5 = 0) / count(*)), 6) AS health FROM supplier GROUP BY 1")
def a23_dependency_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("deps"), F.count_if(F.col("s_acctbal") < 0).alias("o"), F.count_if(F.col("s_suppkey") % 5 == 0).alias("v"))
    return s.select("nation", "deps", F.round(supply.health_score(F.col("o"), F.col("v"), F.lit(0), F.col("deps")), 6).alias("health"))


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part, some without a class of risk."""
    p, k = tables.table(spark, sf_dir, "part"), F.col("p_size")
    sev = F.when(k <= 5, "critical").when(k <= 15, "high").when(k <= 30, "medium").when(k <= 40, "low").otherwise("info")
    return p.select(F.col("p_partkey").alias("id"), sev.alias("severity"), (k % 3 != 0).alias("enabled"), F.when(k % 4 != 0, F.concat(F.lit("A0"), (k % 10).cast("string"), F.lit(":2021"))).alias("owasp"))


_PART_RULES = "(SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN 'critical' WHEN p_size <= 15 THEN 'high' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 40 THEN 'low' ELSE 'info' END AS severity, p_size % 3 <> 0 AS enabled, CASE WHEN p_size % 4 <> 0 THEN 'A0' || CAST(p_size % 10 AS VARCHAR) || ':2021' END AS owasp FROM part) r"


@query(f"SELECT owasp, count(*) AS rules FROM {_PART_RULES} WHERE owasp IS NOT NULL GROUP BY owasp")
def a24_owasp_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coverage(_part_rules(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled, {LEVEL_COUNTS} FROM {_PART_RULES}")
def a25_rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.statistics(_part_rules(spark, sf_dir))


@query("""SELECT file_path, minutes, ratio, CASE WHEN ratio <= 0.05 THEN 'A' WHEN ratio <= 0.1 THEN 'B' WHEN ratio <= 0.2 THEN 'C' WHEN ratio <= 0.5 THEN 'D' ELSE 'E' END AS rating FROM (
SELECT file_path, minutes, round(minutes / (loc * 0.5), 4) AS ratio FROM (SELECT file_path, sum(CASE type WHEN 'security' THEN CASE WHEN severity = 'critical' THEN 90.0 ELSE 60.0 END WHEN 'performance' THEN 30.0 ELSE 15.0 END)::DOUBLE AS minutes, 1000.0::DOUBLE * count(DISTINCT line_start) AS loc FROM findings GROUP BY file_path))""")
def a28_debt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = dashboard.tech_debt_minutes(tables.findings(spark, sf_dir)).groupBy("file_path").agg(F.sum("minutes").alias("minutes"), (F.lit(1000.0) * F.countDistinct("line_start")).alias("loc"))
    ratio, rating = dashboard.sqale(F.col("minutes"), F.col("loc"))
    return f.select("file_path", "minutes", ratio.alias("ratio"), rating.alias("rating"))


@query("""SELECT doc_id, total, blank, comment, total - blank - comment AS code FROM (SELECT doc_id, CAST(len(l) AS BIGINT) AS total, CAST(len(list_filter(l, lambda x: trim(x) = '')) AS BIGINT) AS blank, CAST(len(list_filter(l, lambda x: starts_with(trim(x), '//'))) AS BIGINT) AS comment FROM (SELECT doc_id, string_split(content, chr(10)) AS l FROM files))""")
def a32_line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir).select("doc_id", F.split("content", "\n", -1).alias("l"))
    blank, comment = F.size(F.filter("l", lambda x: F.trim(x) == "")), F.size(F.filter("l", lambda x: F.startswith(F.trim(x), F.lit("//"))))
    return f.select("doc_id", F.size("l").cast("long").alias("total"), blank.cast("long").alias("blank"), comment.cast("long").alias("comment"), (F.size("l") - blank - comment).cast("long").alias("code"))


@query("SELECT review_id, ord, tie, severity, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, severity, substring(message, 1, 50) ORDER BY ord, tie, confidence, suggestion, review_id, line_end, type, category NULLS FIRST, source, rule_id, metric_value) AS k FROM findings) WHERE k = 1")
def d2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedup_exact(tables.findings(spark, sf_dir), ORDER).select("review_id", "ord", "tie", "severity", "confidence")


@query()
def d2_similar_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedup_similar(tables.findings(spark, sf_dir), ORDER).select("review_id", "ord", "tie", "severity", "confidence")


@query("""SELECT review_id, ord, tie, round(least(100.0, CASE severity WHEN 'critical' THEN 100.0 WHEN 'high' THEN 75.0 WHEN 'medium' THEN 50.0 WHEN 'low' THEN 25.0 WHEN 'info' THEN 10.0 ELSE 50.0 END::DOUBLE
 * CASE kind WHEN 'security' THEN 1.5 WHEN 'performance' THEN 1.3 WHEN 'correctness' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN confidence >= 0.9 THEN 1.2 WHEN confidence >= 0.8 THEN 1.1 ELSE 1.0 END::DOUBLE
 * CASE WHEN suggestion <> '' THEN 1.15 ELSE 1.0 END::DOUBLE * CASE WHEN type = 'security' OR kind = 'security' THEN 1.3 ELSE 1.0 END::DOUBLE), 6) AS priority_score FROM ranked""")
def d3_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.priority(tables.findings(spark, sf_dir))
    return f.select("review_id", "ord", "tie", F.round("priority_score", 6).alias("priority_score"))


@query()
def d4_fix_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.resolve_conflicts(tables.findings(spark, sf_dir).where("suggestion = 'fix it'"))


CLONES = """, l AS (SELECT file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, unnest(string_split(content, chr(10))) AS s FROM files),
h AS (SELECT file_path, n, md5(regexp_replace(regexp_replace(regexp_replace(trim(s, ' '), '[ ]+', ' ', 'g'), '"[^"]*"', '""', 'g'), '''[^'']*''', '''''', 'g')) AS h FROM l WHERE trim(s, ' ') <> '' AND NOT starts_with(trim(s, ' '), '#')),
w AS (SELECT file_path, n, md5(string_agg(h, '') OVER v) AS h, count(*) OVER v AS c, max(n) OVER v AS m FROM h WINDOW v AS (PARTITION BY file_path ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
k AS (SELECT file_path, n, h FROM w WHERE c = 4 AND m - n = 3),
p AS (SELECT a.file_path AS file1, b.file_path AS file2, a.n AS l1, b.n - a.n AS d FROM k a JOIN k b ON a.h = b.h AND (a.file_path < b.file_path OR (a.file_path = b.file_path AND b.n > a.n))),
i AS (SELECT *, l1 - row_number() OVER (PARTITION BY file1, file2, d ORDER BY l1) AS g FROM p),
runs AS (SELECT file1, file2, min(l1) AS start1, min(l1) + d AS start2, max(l1) - min(l1) + 4 AS length FROM i GROUP BY file1, file2, d, g HAVING file1 <> file2 OR abs(d) >= 4)"""


@query(CLONES + " SELECT file1, file2, start1, start2, length FROM runs")
def d1_clone_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of every size takes part; runs of four lines or more."""
    f = tables.files(spark, sf_dir)
    return clones.clone_runs(clones.code_lines(f), 4).select("file1", "file2", F.col("start1").cast("long").alias("start1"), F.col("start2").cast("long").alias("start2"), "length")


@query("SELECT rnk, line_start, category, ord, tie FROM ranked ORDER BY coalesce(rnk, -1) DESC, line_start, category NULLS FIRST, ord, tie LIMIT 100")
def o1_sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).withColumn("rnk", severity.rank())
    return f.orderBy(F.desc(F.coalesce("rnk", F.lit(-1))), "line_start", "category", "ord", "tie").limit(100).select("rnk", "line_start", "category", "ord", "tie")


@query("SELECT file_path, count(*) AS findings FROM findings GROUP BY file_path ORDER BY findings DESC, min(ord), file_path LIMIT 5")
def o2_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.top_files(tables.findings(spark, sf_dir), 5, ("ord",))


SOURCE_RANK = "CASE source WHEN 'llm' THEN 0 WHEN 'local' THEN 2 WHEN 'rule' THEN 3 ELSE 1 END"


@query(f"SELECT file_path, ord, tie, source FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY {SOURCE_RANK}, ord, tie, confidence, suggestion) AS n FROM findings) WHERE n <= 50")
def o3_cap_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.cap(tables.findings(spark, sf_dir), ["file_path"], 50, [severity.case("source", {"llm": 0, "local": 2, "rule": 3}, 1), *ORDER])
    return f.select("file_path", "ord", "tie", "source")


@query("SELECT file_path, source, ord, tie FROM (SELECT *, row_number() OVER (PARTITION BY file_path, source ORDER BY ord, tie, confidence, suggestion) AS n FROM findings) WHERE n <= 20")
def o4_cap_per_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.cap(tables.findings(spark, sf_dir), ["file_path", "source"], 20, list(ORDER)).select("file_path", "source", "ord", "tie")


@query("SELECT review_id, project_id FROM reviews ORDER BY started_at DESC, review_id DESC LIMIT 50")
def o5_recent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reviews(spark, sf_dir).orderBy(F.desc("started_at"), F.desc("review_id")).limit(50).select("review_id", "project_id")


@query("SELECT severity, file_path, ord, tie FROM findings ORDER BY severity, file_path, ord, tie LIMIT 200")
def o6_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.findings(spark, sf_dir).orderBy("severity", "file_path", "ord", "tie").limit(200).select("severity", "file_path", "ord", "tie")


@query("SELECT source, count(*) AS findings FROM (SELECT source FROM findings WHERE severity = 'critical' UNION ALL SELECT source FROM findings WHERE confidence > 0.9) GROUP BY source")
def u1_bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    return findings.union_sources(f.where("severity = 'critical'").drop("metric_value"), f.where("confidence > 0.9")).groupBy("source").agg(F.count("*").alias("findings"))


@query("SELECT file_path FROM findings WHERE type = 'performance' EXCEPT SELECT file_path FROM findings WHERE severity = 'critical' AND type = 'security'")
def u2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    return f.where("type = 'performance'").select("file_path").subtract(f.where("severity = 'critical' AND type = 'security'").select("file_path"))


@query("SELECT file_path FROM findings WHERE type = 'performance' INTERSECT SELECT file_path FROM findings WHERE severity = 'critical' AND type = 'security'")
def u3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir)
    return f.where("type = 'performance'").select("file_path").intersect(f.where("severity = 'critical' AND type = 'security'").select("file_path"))


@query("SELECT file_path, count(DISTINCT line_start) AS lines, min(line_start) AS first FROM findings GROUP BY file_path")
def u4_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ls"))))
    f = tables.findings(spark, sf_dir).groupBy("file_path", "source").agg(F.collect_set("line_start").alias("ls")).groupBy("file_path").agg(lines.alias("l"))
    return f.select("file_path", F.size("l").cast("long").alias("lines"), F.element_at("l", 1).alias("first"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(content, '[A-Z][a-z]+')) AS BIGINT) AS matches, CASE WHEN regexp_matches(content, '[A-Z][a-z]+') THEN CAST(length(string_split_regex(content, '[A-Z][a-z]+')[1]) AS BIGINT) END AS first_start FROM files")
def x1_match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir).select("doc_id", regex.matches("content", "[A-Z][a-z]+").alias("m"))
    return f.select("doc_id", F.when(F.col("m").isNull(), 0).otherwise(F.size("m")).cast("long").alias("matches"), F.element_at("m", 1)["start"].cast("long").alias("first_start"))


@query("SELECT severity, CASE severity WHEN 'info' THEN 'low' WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' WHEN 'high' THEN 'critical' ELSE severity END AS up, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' WHEN 'low' THEN 'info' ELSE severity END AS down FROM (SELECT DISTINCT severity FROM findings)")
def x8_severity_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.findings(spark, sf_dir).select("severity").distinct()
    return s.select("severity", severity.shift("severity", 1).alias("up"), severity.shift("severity", -1).alias("down"))


@query("SELECT p_partkey AS id, CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT p_partkey, p_size / 5.0 AS s FROM part)")
def x10_cvss_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), severity.cvss_severity(F.col("p_size") / 5.0).alias("severity"))


@query(f"SELECT doc_id, {LICENSE_CASE} AS spdx FROM (SELECT doc_id, lower(content) AS t FROM files)")
def x11_license_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("doc_id", supply.license_id(F.col("content")).alias("spdx"))


@query("""SELECT doc_id, count(*) AS chunks, CAST(sum(len(string_split(c, chr(10)))) AS BIGINT) AS lines FROM (SELECT doc_id, unnest(list_transform(range(0, CASE WHEN n <= 50 THEN 1 ELSE CAST(ceil((n - 50) / 40.0) AS BIGINT) + 1 END), lambda k: array_to_string(list_slice(l, k * 40 + 1, least(k * 40 + 50, n)), chr(10)))) AS c FROM (SELECT doc_id, string_split(content, chr(10)) AS l, len(string_split(content, chr(10))) AS n FROM files)) GROUP BY doc_id""")
def t1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks.line_chunks(tables.files(spark, sf_dir), 100, 10, key="doc_id")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size(F.split("content", "\n", -1))).cast("long").alias("lines"))


@query()
def t4_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.RulesEngine().scan(tables.files(spark, sf_dir), keep=("doc_id", "language"))


@query()
def t5_sast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.RulesEngine(rules.SAST_RULES).scan(tables.files(spark, sf_dir), keep=("doc_id", "language"))


@query("""SELECT review_id, rule, found, allowed FROM (SELECT review_id, unnest([{'rule': 'severity-critical', 'found': c, 'allowed': CAST(0 AS BIGINT)}, {'rule': 'severity-high', 'found': h, 'allowed': CAST(1 AS BIGINT)}], recursive := true) FROM (SELECT review_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM findings GROUP BY review_id)) WHERE found > allowed""")
def g1_severity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.severity_rule(tables.findings(spark, sf_dir), "review_id", 0, 1)


@query("SELECT review_id, count(*) FILTER (file_path LIKE 'src/mod1%' OR file_path LIKE '%.go%') AS found FROM findings GROUP BY review_id HAVING found > 2")
def g2_file_pattern_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.pattern_rule(tables.findings(spark, sf_dir), "review_id", ["src/mod1*", "*\\.go"], 2)


@query("SELECT ord, tie, metric_value FROM findings WHERE category = 'complexity' AND metric_value > 0.05")
def g3_complexity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.metric_rule(tables.findings(spark, sf_dir), 0.05).select("ord", "tie", "metric_value")


@query(f"""SELECT review_id, gate, critical > max_critical OR debt_hours > max_debt AS failed FROM (SELECT review_id, count(*) FILTER (severity = 'critical') AS critical, CAST(sum({HOURS}) AS DOUBLE) AS debt_hours FROM findings GROUP BY review_id), (VALUES ('strict', 0, 8.0), ('loose', 2, 40.0)) g(gate, max_critical, max_debt)""")
def g7_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = spark.createDataFrame([("strict", 0, None, None, 8.0, None), ("loose", 2, None, None, 40.0, None)], "gate string, max_critical long, max_high long, max_total long, max_debt_hours double, min_quality double")
    c = dashboard.review_counters(tables.findings(spark, sf_dir))
    return dashboard.quality_gates(gates, c).select("review_id", "gate", (~F.col("passed")).alias("failed"))



_DETECTED = samples.expected_sql([[(d, "", k) for k, (_, ids) in enumerate(lines, 1) for d in ids] for lines in samples.LINES.values()], "detector")


@query(f"SELECT file_path, ['{"', '".join(samples.LANGUAGES)}'][CAST(file_path AS BIGINT) % 5 + 1] AS language, detector, line FROM ({_DETECTED})")
def t7_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detectors import detect

    f = samples.dealt(spark, sf_dir, ["\n".join(x for x, _ in lines) + "\n" for lines in samples.LINES.values()], list(samples.LANGUAGES))
    return detect(f).select("file_path", "language", "detector", F.col("line_start").alias("line"))


@query(samples.BRANCHES_SQL)
def m1_python_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import python_metrics

    return python_metrics(samples.branches(spark, sf_dir)).select("file_path", "name", "line_start", "loc", "cyclomatic", "cognitive", "nesting", "volume", "maintainability")


@query(f"SELECT count(*) AS functions, round(avg(cyclomatic), 6) AS avg_cyclomatic, max(cyclomatic) AS max_cyclomatic, round(avg(cognitive), 6) AS avg_cognitive, round(avg(maintainability), 4) AS avg_maintainability, count(*) FILTER (cyclomatic > 10 OR cognitive > 15) AS complex FROM ({samples.BRANCHES_SQL})")
def a26_complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import complexity_summary, python_metrics

    c = complexity_summary(python_metrics(samples.branches(spark, sf_dir)))
    return c.select("functions", F.round("avg_cyclomatic", 6).alias("avg_cyclomatic"), "max_cyclomatic", F.round("avg_cognitive", 6).alias("avg_cognitive"), F.round("avg_maintainability", 4).alias("avg_maintainability"), "complex")


@query(samples.expected_sql([found for _, found in samples.PYTHON], '"check"'))
def t8_python_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.python_checks import check_files

    f = samples.dealt(spark, sf_dir, [text for text, _ in samples.PYTHON], ["python"])
    return check_files(f).select("file_path", "check", "severity", F.col("line_start").alias("line"))


@query(f"""SELECT r.project_id, r.review_id, count(f.ord) AS total, {LEVEL_COUNTS.replace("severity", "f.severity")}, coalesce(CAST(sum({HOURS.replace("severity", "f.severity")}) FILTER (f.severity IS NOT NULL) AS DOUBLE), 0.0) AS debt_hours
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, review_id DESC) AS k FROM reviews) r LEFT JOIN findings f USING (review_id) WHERE k = 1 GROUP BY r.project_id, r.review_id""")
def a15_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = dashboard.latest(tables.reviews(spark, sf_dir), "project_id", "started_at", "review_id").select("project_id", "review_id")
    f = last.join(tables.findings(spark, sf_dir), "review_id", "left")
    return f.groupBy("project_id", "review_id").agg(F.count("ord").alias("total"), *severity.counts(), dashboard.debt_hours().alias("debt_hours"))


@query("""SELECT scope, count(*) AS evaluations, count(*) FILTER (passed) AS passed, round(100.0 * count(*) FILTER (passed) / count(*), 4) AS compliance FROM (SELECT r.author AS scope, coalesce(f.c, 0) <= 1 AS passed FROM reviews r LEFT JOIN (SELECT review_id, count(*) FILTER (severity = 'critical') AS c FROM findings GROUP BY review_id) f USING (review_id)) GROUP BY scope""")
def a29_compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = policy.severity_rule(tables.findings(spark, sf_dir), "review_id", 1).select("review_id").distinct().withColumn("bad", F.lit(True))
    r = tables.reviews(spark, sf_dir).join(bad, "review_id", "left").withColumn("passed", F.col("bad").isNull())
    return policy.compliance(r, F.col("author").alias("scope"))


@query(f"SELECT strftime(started_at, '%Y-%m') AS month, count(DISTINCT review_id) AS reviews, {LEVEL_COUNTS} FROM reviews JOIN findings USING (review_id) GROUP BY 1")
def a30_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.reviews(spark, sf_dir).join(tables.findings(spark, sf_dir), "review_id")
    return r.groupBy(F.date_format("started_at", "yyyy-MM").alias("month")).agg(F.countDistinct("review_id").alias("reviews"), *severity.counts())


@query("SELECT file_path, count(*) AS fixes, round(avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM findings WHERE suggestion = 'fix it' GROUP BY file_path")
def a31_batch_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).where("suggestion = 'fix it'")
    return f.groupBy("file_path").agg(F.count("*").alias("fixes"), F.round(F.avg((F.col("confidence") >= 0.8).cast("double")), 6).alias("success_rate"))


@query("SELECT hits, misses, round(CAST(hits AS DOUBLE) / (hits + misses), 6) AS hit_rate FROM (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses FROM events)")
def a33_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.cache import cache_stats

    e = tables.table(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("hit"))
    return cache_stats(e).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT language, count(*) AS files FROM files WHERE language IN ('python', 'go') GROUP BY language")
def p4_rule_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.Rule("x", "x", "x", "low", "m", languages=("Python", "GO"))
    return tables.files(spark, sf_dir).where(rules.fits_language(r, "language")).groupBy("language").agg(F.count("*").alias("files"))


@query("SELECT DISTINCT review_id FROM findings WHERE file_path LIKE 'src/mod3%' AND NOT file_path LIKE '%.js'")
def p9_policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).groupBy("review_id").agg(F.collect_set("file_path").alias("files"))
    return f.where(policy.any_file("files", ["src/mod3*"], ["*.js"])).select("review_id")


@query("""SELECT review_id, ord, tie, priority_score FROM (SELECT *, round(least(100.0, CASE severity WHEN 'critical' THEN 100.0 WHEN 'high' THEN 75.0 WHEN 'medium' THEN 50.0 WHEN 'low' THEN 25.0 WHEN 'info' THEN 10.0 ELSE 50.0 END::DOUBLE
 * CASE kind WHEN 'security' THEN 1.5 WHEN 'performance' THEN 1.3 WHEN 'correctness' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN confidence >= 0.9 THEN 1.2 WHEN confidence >= 0.8 THEN 1.1 ELSE 1.0 END::DOUBLE
 * CASE WHEN suggestion <> '' THEN 1.15 ELSE 1.0 END::DOUBLE * CASE WHEN type = 'security' OR kind = 'security' THEN 1.3 ELSE 1.0 END::DOUBLE), 6) AS priority_score FROM ranked) ORDER BY priority_score DESC, ord, tie LIMIT 50""")
def o9_top_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.priority(tables.findings(spark, sf_dir)).withColumn("priority_score", F.round("priority_score", 6))
    return f.orderBy(F.desc("priority_score"), "ord", "tie").limit(50).select("review_id", "ord", "tie", "priority_score")


def _nation_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each nation, on files of its number."""
    k = F.col("n_nationkey")
    return tables.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("id"), (k * 10).cast("int").alias("priority"), (k % 5 != 4).alias("enabled"), F.array(F.when(k % 2 == 0, "merge").otherwise("pre-commit")).alias("scope"), F.array(F.lit("main")).alias("branches"), F.when(k % 3 == 0, F.array(F.lit("main"))).otherwise(F.array().cast("array<string>")).alias("exclude_branches"),
        F.array(F.concat(F.lit("src/mod"), k.cast("string"), F.lit("/*"))).alias("file_patterns"), F.array(F.lit("*.js"), F.lit("*f[0-1].py")).alias("exclude_patterns"), F.element_at(F.array(F.lit("block"), F.lit("warn"), F.lit("require_approval")), (k % 3 + 1).cast("int")).alias("action"), F.when(k % 4 == 0, "advisory").otherwise("strict").alias("enforcement"),
        F.array(F.lit("security"), F.col("n_name")).alias("required_teams"), k,
    )


@query("SELECT n_name AS id, CAST(n_nationkey * 10 AS INTEGER) AS priority FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey IN (2, 8)")
def o7_policies_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of a scope and branch that some file fits, the most urgent first."""
    files = ["src/mod2/f1.py", "src/mod2/f2.py", "src/mod4/f2.js", "src/mod8/a/b.go", "src/mod10/f0.py", "lib/mod14/x"]
    return policy.applicable(_nation_policies(spark, sf_dir), "merge", "main", files).select("id", "priority")


@query("""SELECT n_name AS id, count(*) AS reviews FROM nation JOIN (SELECT DISTINCT review_id, regexp_extract(file_path, 'src/mod(\\d+)/', 1) AS k FROM findings WHERE NOT file_path LIKE '%.js' AND NOT regexp_matches(file_path, 'f[0-1]\\.py$')) f ON CAST(n_nationkey AS VARCHAR) = f.k GROUP BY n_name""")
def p9_applicable_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that each policy applies to: those with a finding in some file that its patterns fit."""
    p = _nation_policies(spark, sf_dir)
    f = tables.findings(spark, sf_dir).select("review_id", "file_path").distinct()
    # Candidates by the folder's number, then the patterns themselves.
    pairs = f.withColumn("n_nationkey", F.regexp_extract("file_path", r"src/mod(\d+)", 1).cast("int")).groupBy("review_id", "n_nationkey").agg(F.collect_set("file_path").alias("files")).join(p, "n_nationkey")
    return pairs.where(policy.fits_files(F.col("files"), F.col("file_patterns"), F.col("exclude_patterns"))).groupBy("id").agg(F.count("*").alias("reviews"))


@query("""SELECT n_name AS id, count(*) AS violations, n_nationkey % 3 = 2 AS requires_approval, CASE WHEN n_nationkey % 3 = 2 THEN least(n_name, 'security') || ',' || greatest(n_name, 'security') ELSE '' END AS teams, n_nationkey % 3 = 1 OR n_nationkey % 4 = 0 AS warns FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 3000 GROUP BY n_name, n_nationkey""")
def g6_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _nation_policies(spark, sf_dir)
    v = tables.table(spark, sf_dir, "supplier").where("s_acctbal < 3000").join(p.select("n_nationkey", F.col("id").alias("policy_id")), F.col("s_nationkey") == F.col("n_nationkey")).select("policy_id")
    return policy.approvals(v, p).select("id", "violations", "requires_approval", F.array_join("teams", ",").alias("teams"), "warns")


@query("SELECT kind, count(*) AS findings FROM ranked GROUP BY kind ORDER BY findings DESC, kind LIMIT 3")
def o8_categories_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_category(tables.findings(spark, sf_dir)).orderBy(F.desc("findings"), "kind").limit(3)


@query("SELECT doc_id, regexp_matches(content, '(?i)license') AS mentions FROM files")
def x2_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("doc_id", F.col("content").rlike(regex.flags("license", ignore_case=True)).alias("mentions"))


@query("SELECT doc_id, md5(content) AS md5, sha256(content) AS sha256, substring(sha256(content), 1, 12) AS short FROM files")
def x5_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("doc_id", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 12).alias("short"))


@query("SELECT file_path, file_path LIKE 'src/mod1_/%' AS two_digits, file_path LIKE '%.go' AS go FROM (SELECT DISTINCT file_path FROM findings)")
def x6_fnmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.findings(spark, sf_dir).select("file_path").distinct()
    return f.select("file_path", regex.glob("file_path", "src/mod1?/*").alias("two_digits"), regex.glob("file_path", "*.go").alias("go"))


@query("SELECT spdx, count(*) AS files, count(*) FILTER (spdx IN ('MIT', 'Apache-2.0')) AS allowed, count(*) FILTER (spdx = 'GPL-3.0') AS risky FROM (SELECT " + LICENSE_CASE + " AS spdx FROM (SELECT lower(content) AS t FROM files)) WHERE spdx IS NOT NULL GROUP BY spdx")
def x12_license_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir).select(supply.license_id(F.col("content")).alias("spdx")).where("spdx IS NOT NULL")
    cat = supply.license_category(F.col("spdx"))
    ok = supply.license_allowed(F.col("spdx"), cat, denied=("Unlicense",), allowed_categories=("permissive",))
    risky = supply.license_risk(F.col("spdx"), cat, denied_categories=("strong_copyleft",)).isin("critical", "high")
    return f.groupBy("spdx").agg(F.count("*").alias("files"), F.count_if(ok).alias("allowed"), F.count_if(risky).alias("risky"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY AS recent FROM orders")
def x15_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.expr("o_orderdate >= timestamp_ntz '1998-08-01 00:00:00' - interval 365 days").alias("recent"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def x19_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import escape

    return tables.table(spark, sf_dir, "pages").select("page_id", escape("html").alias("escaped"))


@query("SELECT doc_id, md5(regexp_replace(content, '[A-Za-z0-9]{24,}', '[REDACTED]', 'g')) AS redacted FROM files")
def x20_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace("content", "[A-Za-z0-9]{24,}", F.lit("[REDACTED]"))).alias("redacted"))


@query("""SELECT doc_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM files""")
def x17_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(spark, sf_dir).select("doc_id", F.ceil(F.length("content") / 4.0).cast("long").alias("tokens"))


@query("""SELECT p.id, p.action, p.enforcement, coalesce(v.n, 0) AS violations, coalesce(v.n, 0) = 0 AS passed, coalesce(v.n, 0) > 0 AND p.action = 'block' AND p.enforcement = 'strict' AS blocks, coalesce(v.n, 0) > 0 AND p.enforcement = 'flexible' AS can_override
FROM (VALUES ('src/mod1', 'block', 'strict'), ('src/mod2', 'block', 'flexible'), ('src/mod3', 'warn', 'strict'), ('lib', 'block', 'strict')) p(id, action, enforcement)
LEFT JOIN (SELECT split_part(file_path, '/', 1) || '/' || substring(split_part(file_path, '/', 2), 1, 4) AS id, count(*) AS n FROM findings WHERE severity = 'critical' GROUP BY 1) v USING (id)""")
def g6_policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([("src/mod1", "block", "strict"), ("src/mod2", "block", "flexible"), ("src/mod3", "warn", "strict"), ("lib", "block", "strict")], "id string, action string, enforcement string")
    f = tables.findings(spark, sf_dir).where("severity = 'critical'")
    return policy.verdicts(f.select(F.regexp_extract("file_path", "^[^/]*/.{4}", 0).alias("policy_id")), policies)


@query("SELECT doc_id, CAST(len(string_split(content, chr(10))) AS BIGINT) AS end_line FROM files")
def t2_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.CHUNKERS["file_based"](tables.files(spark, sf_dir), key="doc_id").select("doc_id", F.col("end_line").cast("long").alias("end_line"))


@query(f"SELECT file_path, name, CAST(5 * greatest(cyclomatic - 10, 0) + 5 * greatest(cognitive - 15, 0) + CASE WHEN maintainability < 65 THEN 30 ELSE 0 END + 15 * greatest(nesting - 4, 0) AS BIGINT) AS minutes FROM ({samples.BRANCHES_SQL})")
def m14_debt_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import debt_minutes, python_metrics

    return debt_minutes(python_metrics(samples.branches(spark, sf_dir))).select("file_path", "name", F.col("minutes").cast("long").alias("minutes"))


_WEAK = ", ".join(f"({k}, '{cwe}', '{name}', '{grave}')" for k, (cwe, name, grave) in enumerate(WEAKNESSES))


@query(f"SELECT cwe, v.name, v.severity, count(*) AS findings FROM lineitem JOIN (VALUES {_WEAK}) v(k, cwe, name, severity) ON l_partkey % 17 = k GROUP BY cwe, v.name, v.severity")
def t6_weakness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the weakness that they name; some name none that is known."""
    from .weaknesses import weaknesses

    names = F.array(*[F.lit(c) for c, _, _ in WEAKNESSES])
    f = tables.table(spark, sf_dir, "lineitem").select(F.get(names, (F.col("l_partkey") % 17).cast("int")).alias("cwe"))
    return f.groupBy("cwe").agg(F.count("*").alias("findings")).join(weaknesses(spark), "cwe").select("cwe", "name", "severity", "findings")


@query(samples.expected_sql([found for _, found in samples.PATHS], '"check"'))
def e1_lateral_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyzers as a table function in SQL."""
    from ..operators import analyzers

    analyzers.register_functions(spark)
    samples.dealt(spark, sf_dir, [text for text, _ in samples.PATHS], ["python"]).createOrReplaceTempView("gristmill_sources")
    return spark.sql("SELECT file_path, a.check, a.severity, a.line_start AS line FROM gristmill_sources, LATERAL analyze(language, content) a WHERE a.check IN ('resource-leak', 'mixed-returns', 'shared-state')")


@query("SELECT severity, count(*) AS findings, count(DISTINCT file_path || ':' || CAST(line_start AS VARCHAR) || message) AS lines FROM findings GROUP BY severity")
def k3_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import markdown

    m = markdown(tables.findings(spark, sf_dir))
    return m.select("severity", "findings", (F.size(F.split("section", "\n")) - 1).cast("long").alias("lines"))


@query("SELECT review_id, CASE WHEN m = 4 THEN 'blocked' WHEN m = 3 THEN 'needs work' WHEN m >= 1 THEN 'comments' ELSE 'clean' END AS badge, n AS findings, least(n, 3) AS shown FROM (SELECT review_id, max(coalesce(rnk, -1)) AS m, count(*) AS n FROM ranked GROUP BY review_id)")
def k4_pr_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import pr_comment

    return pr_comment(tables.findings(spark, sf_dir), ["review_id"], list(ORDER), 3).withColumn("shown", F.col("shown").cast("long"))


@query("""SELECT review_id, ord, kind AS rule, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file_path AS uri, line_start AS line, message, substring(md5(concat_ws(':', file_path, CAST(line_start AS VARCHAR), message)), 1, 16) AS fingerprint FROM (SELECT *, coalesce(category, type) AS k FROM ranked)""".replace("kind AS rule", "k AS rule"))
def k1_sarif_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result, read back from its JSON."""
    from ..sources.sinks import sarif_results

    shape = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,endLine:bigint>>>>, partialFingerprints struct<primary:string>"
    f = tables.findings(spark, sf_dir)
    r = sarif_results(f, keep=("review_id", "ord")).withColumn("r", F.from_json("result", shape))
    place = F.col("r.locations")[0]["physicalLocation"]
    return r.select("review_id", "ord", F.col("r.ruleId").alias("rule"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), F.col("r.message.text").alias("message"), F.col("r.partialFingerprints.primary").alias("fingerprint"))


@query("SELECT fix, (SELECT count(*) FROM supplier) AS fixes FROM (VALUES ('var'), ('none-comparison')) v(fix)")
def e2_fix_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fixes import propose_fixes

    s = spark.createDataFrame([("a.js", "javascript", "var x = 1\n", 1, "Use 'let' or 'const' instead of 'var'"), ("b.py", "python", "\nif x == None: pass\n", 2, "Use 'is None' for None checks")], "name string, language string, content string, line_start long, message string")
    f = tables.table(spark, sf_dir, "supplier").select("s_suppkey").join(F.broadcast(s)).withColumn("file_path", F.concat(F.col("s_suppkey").cast("string"), F.lit("/"), F.col("name"))).withColumn("line_end", F.col("line_start"))
    return propose_fixes(f.select("file_path", "line_start", "line_end", "message"), f.select("file_path", "language", "content")).groupBy("fix").agg(F.count("*").alias("fixes"))


_EDITED_TEXTS = ", ".join("({}, '{}', {})".format(k, after.replace("'", "''"), n) for k, (_, _, after, n) in enumerate(samples.EDITS))


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS file_path, md5(repeat(chr(10), CAST(s_suppkey % 5 AS INTEGER)) || replace(after, 'KEY', CAST(s_suppkey AS VARCHAR))) AS digest, CAST(n AS BIGINT) AS applied FROM supplier JOIN (VALUES {_EDITED_TEXTS}) v(k, after, n) ON s_suppkey % {len(samples.EDITS)} = k")
def e2_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with all their fixes put in, every kind of fix among them."""
    from ..operators import edits

    f = samples.dealt(spark, sf_dir, [before for _, before, _, _ in samples.EDITS], [language for language, *_ in samples.EDITS])
    f = f.withColumn("content", F.replace("content", F.lit("KEY"), F.col("file_path")))
    return edits.apply_edits(f, edits.propose_edits(f)).select("file_path", F.md5("content").alias("digest"), "applied")


@query("SELECT file_path, md5(content || chr(10) || '# checked') AS digest FROM files WHERE content NOT LIKE '%' || chr(10) || '%'")
def d5_apply_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one line get a second one."""
    f = tables.files(spark, sf_dir).where(~F.contains("content", F.lit("\n"))).select("file_path", "content")
    fixes = f.select("file_path", F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"), F.concat("content", F.lit("\n# checked")).alias("new_code"))
    return intervals.apply_fixes(f, fixes).select("file_path", F.md5("content").alias("digest"))


@query(samples.expected_sql([found for _, found in samples.BLOCKS], '"check"'))
def t9_block_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.braces import check_blocks

    f = samples.dealt(spark, sf_dir, [text for text, _ in samples.BLOCKS], ["go"])
    return check_blocks(f).select("file_path", "check", "severity", F.col("line_start").alias("line"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a tree: texts that lose and gain lines, pages that come, items that go, customers that move."""
    t = lambda name: tables.table(spark, sf_dir, name)
    path = lambda folder, key: F.concat(F.lit(folder), F.col(key).cast("string")).alias("file_path")
    edited = F.expr("array_join(flatten(transform(split(text, '\\n', -1), (x, i) -> CASE WHEN i % 5 = 3 THEN cast(array() AS array<string>) WHEN i % 7 = 2 THEN array(x, concat('new line ', i)) ELSE array(x) END)), '\\n')")
    d, c = t("documents"), t("customer")
    old = d.select(path("doc/", "doc_id"), F.col("text").alias("content")).unionByName(t("benchmark").select(path("item/", "item_id"), F.col("text").alias("content"))).unionByName(c.select(path("old/", "c_custkey"), F.col("c_name").alias("content")))
    new = d.select(path("doc/", "doc_id"), edited.alias("content")).unionByName(t("pages").select(path("page/", "page_id"), F.col("html").alias("content"))).unionByName(c.select(path("new/", "c_custkey"), F.col("c_name").alias("content")))
    return old, new


_EDITED = """array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN [] WHEN (i - 1) % 7 = 2 THEN [x, 'new line ' || CAST(i - 1 AS VARCHAR)] ELSE [x] END)), chr(10))"""


@query(f"""SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN coalesce(text, '') = coalesce({_EDITED}, '') THEN 'unchanged' ELSE 'modified' END AS status, CAST(NULL AS VARCHAR) AS old_path,
  CASE WHEN coalesce(text, '') <> coalesce({_EDITED}, '') THEN md5({_EDITED}) END AS digest FROM documents
UNION ALL SELECT 'page/' || CAST(page_id AS VARCHAR), 'added', NULL, md5(coalesce(html, '')) FROM pages UNION ALL SELECT 'item/' || CAST(item_id AS VARCHAR), 'deleted', NULL, NULL FROM benchmark
UNION ALL SELECT 'new/' || CAST(c_custkey AS VARCHAR), 'renamed', 'old/' || CAST(c_custkey AS VARCHAR), NULL FROM customer""")
def s9_diff_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file, and the new text of each changed one, made of the old text and the hunks."""
    from ..operators import diffs

    old, new = _versions(spark, sf_dir)
    made = diffs.apply_hunks(old, diffs.diff_files(old, new, context=3)).select(F.col("file_path").alias("_path"), F.md5("content").alias("digest"))
    c = diffs.file_changes(old, new)
    return c.join(made, c["file_path"] == F.col("_path"), "left").select("file_path", "status", "old_path", "digest")


@query(f"""SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, false AS is_new, false AS is_deleted, true AS has_changes FROM documents WHERE coalesce(text, '') <> coalesce({_EDITED}, '')
UNION ALL SELECT 'page/' || CAST(page_id AS VARCHAR), true, false, true FROM pages UNION ALL SELECT 'item/' || CAST(item_id AS VARCHAR), false, true, true FROM benchmark""")
def s10_diff_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import diffs

    return diffs.diff_flags(diffs.unified(diffs.diff_files(*_versions(spark, sf_dir)))).select("file_path", "is_new", "is_deleted", "has_changes")


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS file_path, count(*) OVER w AS members, min('p' || CAST(p_partkey AS VARCHAR)) OVER w AS first_key FROM part WINDOW w AS (PARTITION BY p_size % 7)
QUALIFY members > 1""")
def d6_clone_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of seven shapes, every name of them different in every file."""
    from ..operators import fingerprints

    k, shape = F.col("p_partkey").cast("string"), (F.col("p_size") % 7).cast("string")
    code = F.concat(F.lit("def f"), k, F.lit("(a"), k, F.lit("):\n    b"), k, F.lit(" = a"), k, F.lit(" + "), shape, F.lit("\n    return print(b"), k, F.lit(" * 2)\n"))
    f = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("file_path"), F.lit("python").alias("language"), code.alias("content"))
    return fingerprints.clone_members(fingerprints.fingerprints(f)).select("file_path", "members", "first_key")


@query("""SELECT o_orderkey AS review_id, o_custkey % 97 AS project_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 100000 THEN 'late ' || o_orderpriority ELSE o_orderpriority END AS author
FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -1 - c_custkey, c_custkey, CASE WHEN c_nationkey > 12 THEN 'O' ELSE 'new' END, NULL FROM customer""")
def s12_changed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews put, updated, deleted and created if absent, some changes older than those before them, with a compaction between."""
    from ..sources.changing import ChangingTable
    from ..sources.workdir import work_dir

    t = ChangingTable(spark, work_dir(spark, "reviews"), "review_id long, project_id long, status string, author string", ["review_id"])
    r, o = tables.reviews(spark, sf_dir), tables.table(spark, sf_dir, "orders")
    c = tables.table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("review_id"), F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("nation"))
    t.put(r, at=10)
    t.put(r.where("status = 'F'").select("review_id", F.lit("closed").alias("status")), at=30)
    t.put(r.where("status = 'F'").select("review_id", F.lit("older").alias("status")), at=20)  # comes late, changes nothing
    t.delete(r.where("status = 'P'"), at=40)
    t.compact()
    t.create(c.select("review_id", "project_id", F.lit("new").alias("status")).unionByName(r.where("status = 'O'").select("review_id", "project_id", F.lit("never").alias("status"))), at=50)
    t.put(o.where("o_totalprice > 100000 AND o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("review_id"), F.concat(F.lit("late "), "o_orderpriority").alias("author")), at=60, batch="authors")
    t.put(o.where("o_totalprice > 100000 AND o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("review_id"), F.concat(F.lit("late "), "o_orderpriority").alias("author")), at=60, batch="authors")  # the job runs again
    t.put(c.where("nation > 12").select("review_id", F.lit("O").alias("status")), at=70)
    return t.read()


@query("""SELECT event_id, user_id FROM (SELECT *, max(ts) OVER () AS latest FROM events) WHERE event_type <> 'error' AND latest - ts <= INTERVAL 10 DAY""")
def s13_cache_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a cache that were neither invalidated nor are older than ten days."""
    from ..sources.changing import ChangingTable
    from ..sources.workdir import work_dir

    t = ChangingTable(spark, work_dir(spark, "cache"), "event_id long, user_id long, event_type string", ["event_id"])
    e = tables.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t.put(e, at=micros)
    latest = e.agg(F.max("ts").alias("ts")).first()["ts"]
    t.delete_where("event_type = 'error'", at=F.unix_micros(F.lit(latest).cast("timestamp")) + 1)
    return t.read(ttl_seconds=10 * 86400, now=F.lit(latest).cast("timestamp")).select("event_id", "user_id")


@query(samples.expected_sql([found for _, found in samples.PATHS], '"check"'))
def t11_path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.paths import check_paths

    f = samples.dealt(spark, sf_dir, [text for text, _ in samples.PATHS], ["python"])
    return check_paths(f).select("file_path", "check", "severity", F.col("line_start").alias("line"))


@query(samples.expected_sql([found for *_, found in samples.SCOPES], '"check"'))
def t10_scope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scope_checks import check_scopes

    f = samples.dealt(spark, sf_dir, [text for _, text, _ in samples.SCOPES], [language for language, *_ in samples.SCOPES])
    return check_scopes(f).select("file_path", "check", "severity", F.col("line_start").alias("line"))


@query(samples.expected_sql([found for _, found in samples.TAINT], "sink"))
def m15_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.python_checks import check_files

    f = samples.dealt(spark, sf_dir, [text for text, _ in samples.TAINT], ["python"])
    t = check_files(f).where("check = 'taint'")
    return t.select("file_path", F.regexp_extract("message", "flows to (.*)$", 1).alias("sink"), "severity", F.col("line_start").alias("line"))


@query("""SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files""")
def a27_duplication_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    r = clones.report(f, clones.clone_blocks(clones.code_lines(f), 6))
    return r.select("files", F.col("lines").cast("long").alias("lines"))


# Runs of six lines. A run of n gives a block at each start with six lines before it ends: n to 6 lines long.
CLONES6 = CLONES.replace("3 FOLLOWING", "5 FOLLOWING").replace("c = 4 AND m - n = 3", "c = 6 AND m - n = 5").replace("+ 4 AS length", "+ 6 AS length").replace("abs(d) >= 4", "abs(d) >= 6")


@query(CLONES6 + """, t AS (SELECT count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files),
u AS (SELECT CAST(coalesce(sum(length * (length + 1) // 2 - 15), 0) AS BIGINT) AS duplicated_lines, CAST(coalesce(sum(length - 5), 0) AS BIGINT) AS blocks FROM runs)
SELECT files, lines, duplicated_lines, blocks, CASE WHEN lines > 0 THEN round(duplicated_lines / lines * 100, 2) ELSE 0.0 END AS percentage FROM t, u""")
def a27_duplication_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, of which ``a27_duplication_totals`` has files and lines."""
    f = tables.files(spark, sf_dir)
    r = clones.report(f, clones.clone_blocks(clones.code_lines(f), 6))
    return r.select("files", F.col("lines").cast("long").alias("lines"), F.col("duplicated_lines").cast("long").alias("duplicated_lines"), "blocks", "percentage")


@query("SELECT o_orderpriority AS scope, round(avg(o_totalprice) / 1000, 4) AS coverage, avg(o_totalprice) / 1000 >= 140 AS passed FROM orders GROUP BY o_orderpriority")
def g4_coverage_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scope")).agg((F.avg("o_totalprice") / 1000).alias("coverage"))
    return c.select("scope", F.round("coverage", 4).alias("coverage"), (F.col("coverage") >= 140).alias("passed"))


@query("SELECT review_id, count(*) AS results, count(DISTINCT coalesce(category, type)) AS rules, count(*) AS parsed, string_agg(DISTINCT coalesce(category, type), ',' ORDER BY coalesce(category, type)) AS ids FROM findings GROUP BY review_id")
def k1_sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole document for each review, read back."""
    from ..sources.sinks import sarif_documents

    shape = "version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>"
    d = sarif_documents(tables.findings(spark, sf_dir), "review_id").withColumn("d", F.from_json("document", shape))
    run = F.col("d.runs")[0]
    return d.select("review_id", "results", "rules", F.size(run["results"]).cast("long").alias("parsed"), F.array_join(run["tool"]["driver"]["rules"]["id"], ",").alias("ids"))


@query(f"""SELECT r.review_id, r.n AS findings, least(r.n, 3) AS shown, '<ul><li class="critical">critical: ' || r.critical || '</li><li class="high">high: ' || r.high || '</li><li class="medium">medium: ' || r.medium || '</li><li class="low">low: ' || r.low || '</li><li class="info">info: ' || r.info || '</li></ul>' AS counted
FROM (SELECT review_id, count(*) AS n, {LEVEL_COUNTS} FROM findings GROUP BY review_id) r""")
def k3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import html_report

    h = html_report(tables.findings(spark, sf_dir), ["review_id"], ["ord", "tie"], 3)
    return h.select("review_id", "findings", (F.size(F.split("html", "<tr>")) - 1).cast("long").alias("shown"), F.regexp_extract("html", "<ul>.*</ul>", 0).alias("counted"))


@query(f"""SELECT review_id, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'clean' END AS status, total, least(total, 5) AS shown, worst FROM (
SELECT review_id, count(*) AS total, {LEVEL_COUNTS}, arg_min(file_path || ':' || line_start, (-coalesce(rnk, -1), ord, tie)) AS worst FROM ranked GROUP BY review_id)""")
def k5_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is posted to a chat, read back from its JSON. Of equals, ``arg_min`` keeps the first in the table."""
    from ..sources.sinks import messages

    shape = "status string, total bigint, findings array<struct<severity:string,place:string,message:string>>"
    m = messages(tables.findings(spark, sf_dir, place=True), ["review_id"], ["ord", "tie", "in_file", "in_row"]).withColumn("p", F.from_json("payload", shape))
    return m.select("review_id", "status", "p.total", F.size("p.findings").cast("long").alias("shown"), F.col("p.findings")[0]["place"].alias("worst"))


@query("""SELECT p_partkey AS policy_id, unnest(list_filter([CASE WHEN c = 0 AND h = 0 THEN 'severity-strict' ELSE 'severity-moderate' END, CASE WHEN c = 0 THEN 'security-zero-tolerance' END,
 CASE WHEN x > 0 THEN CASE WHEN x <= 10 THEN 'complexity-strict' ELSE 'complexity-moderate' END END, CASE WHEN v >= 0.9 THEN 'coverage-90' WHEN v >= 0.8 THEN 'coverage-80' END,
 CASE WHEN f = 1 THEN 'security-files-zero-issues' END, CASE WHEN f = 2 THEN 'api-files-low-issues' END], lambda r: r IS NOT NULL)) AS rule_id
FROM (SELECT p_partkey, p_size % 3 AS c, p_size % 4 AS h, p_partkey % 21 AS x, p_size / 50.0 AS v, p_partkey % 3 AS f FROM part)""")
def g8_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that policies' settings ask for, met with the registry."""
    p = tables.table(spark, sf_dir, "part")
    files = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("**/auth/**"))).when(F.col("p_partkey") % 3 == 2, F.array(F.lit("src/api/*"))).otherwise(F.array(F.lit("*.py")))
    p = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("max_critical"), (F.col("p_size") % 4).alias("max_high"), (F.col("p_partkey") % 21).alias("max_complexity"), (F.col("p_size") / 50.0).alias("min_coverage"), files.alias("file_patterns"))
    return policy.rules_of(p.select("id", policy.default_rules().alias("rules")), policy.registry(spark)).select("policy_id", "rule_id")


@query("""SELECT s_suppkey AS policy_id, 'severity-strict' AS rule_id, CAST(0 AS BIGINT) AS position FROM supplier UNION ALL SELECT s_suppkey, 'coverage-90', 2 FROM supplier WHERE s_suppkey % 2 = 0""")
def j7_policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that no rule has are passed over."""
    s = tables.table(spark, sf_dir, "supplier")
    p = s.select(F.col("s_suppkey").alias("id"), F.array(F.lit("severity-strict"), F.lit("no such rule"), F.when(F.col("s_suppkey") % 2 == 0, "coverage-90").otherwise("nor this one")).alias("rules"))
    return policy.rules_of(p, policy.registry(spark)).select("policy_id", "rule_id", F.col("position").cast("long").alias("position"))
