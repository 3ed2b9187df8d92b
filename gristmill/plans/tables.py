"""The engine's tables (files, projects, reviews, findings, feedback, ...) over the tables at hand.

Each DataFrame here has its SQL twin in ``CTE``, from which the reference SQL of the queries is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str):
    return F.col(c).cast("string")


def findings(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """One finding a line item. ``ord`` and ``tie`` give an order that large tables may leave open for a few rows.

    With ``place``, ``in_file`` and ``in_row`` close it: where a row stands in the table's files, in order of their names.
    """
    li = table(spark, sf_dir, "lineitem")
    ext = F.when(F.col("l_partkey") % 3 == 0, ".py").when(F.col("l_partkey") % 3 == 1, ".js").otherwise(".go")
    kind = F.when(F.col("l_linenumber") % 4 == 0, "security").when(F.col("l_linenumber") % 4 == 1, "performance").when(F.col("l_linenumber") % 4 == 2, "correctness").otherwise("maintainability")
    q = F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("review_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_extendedprice").alias("tie"),
        F.concat(F.lit("src/mod"), (F.col("l_partkey") % 40).cast("string"), F.lit("/f"), (F.col("l_suppkey") % 5).cast("string"), ext).alias("file_path"),
        (F.col("l_partkey") % 60 + 1).alias("line_start"), (F.col("l_partkey") % 60 + 1 + F.col("l_linenumber")).alias("line_end"),
        F.when(q <= 3, "critical").when(q <= 12, "high").when(q <= 30, "medium").when(q <= 45, "low").when(q <= 49, "info").otherwise("unknown").alias("severity"),
        kind.alias("type"), F.when(F.col("l_returnflag") == "A", "security").when(F.col("l_returnflag") == "R", "complexity").alias("category"),
        F.concat(F.lit("Issue "), (F.col("l_partkey") % 17).cast("string"), F.lit(" in statement")).alias("message"),
        F.when(F.col("l_linestatus") == "O", "fix it").otherwise("").alias("suggestion"), F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, "llm").when(F.col("l_linenumber") % 3 == 1, "local").otherwise("rule").alias("source"),
        F.concat(F.lit("rule-"), (F.col("l_partkey") % 25).cast("string")).alias("rule_id"), F.col("l_tax").alias("metric_value"),
        *([F.col("_metadata.file_path").alias("in_file"), F.col("_metadata.row_index").alias("in_row")] if place else []),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("review_id"), (F.col("o_custkey") % 97).alias("project_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("author"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey < 97").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "modify").when(F.col("event_type") == "view", "skip").otherwise("reject")
    sev = F.when(F.col("event_id") % 7 == 0, "critical").when(F.col("event_id") % 7 <= 2, "high").when(F.col("event_id") % 7 <= 4, "medium").otherwise("low")
    return e.select("event_id", "ts", F.concat(F.lit("rule-"), _text("user_id")).alias("rule_id"), kind.alias("feedback_type"), sev.alias("severity"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "java").when(F.col("lang") == "fr", "javascript").otherwise("go")
    return d.select("doc_id", F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), _text("doc_id"), F.lit(".txt")).alias("file_path"), lang.alias("language"), F.col("text").alias("content"), "lang", "source")


def debt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pr = F.when(F.col("p_size") <= 5, "critical").when(F.col("p_size") <= 15, "high").when(F.col("p_size") <= 30, "medium").otherwise("low")
    st = F.when(F.col("p_partkey") % 3 == 0, "open").when(F.col("p_partkey") % 3 == 1, "in_progress").otherwise("resolved")
    return p.select(F.col("p_partkey").alias("item_id"), pr.alias("priority"), st.alias("status"), F.col("p_size").cast("double").alias("estimated_hours"))


CTE = """
findings AS (SELECT l_orderkey AS review_id, l_orderkey * 10 + l_linenumber AS ord, l_extendedprice AS tie,
  'src/mod' || CAST(l_partkey % 40 AS VARCHAR) || '/f' || CAST(l_suppkey % 5 AS VARCHAR) || CASE l_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.go' END AS file_path,
  l_partkey % 60 + 1 AS line_start, l_partkey % 60 + 1 + l_linenumber AS line_end,
  CASE WHEN l_quantity <= 3 THEN 'critical' WHEN l_quantity <= 12 THEN 'high' WHEN l_quantity <= 30 THEN 'medium' WHEN l_quantity <= 45 THEN 'low' WHEN l_quantity <= 49 THEN 'info' ELSE 'unknown' END AS severity,
  CASE l_linenumber % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'correctness' ELSE 'maintainability' END AS type,
  CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'R' THEN 'complexity' END AS category,
  'Issue ' || CAST(l_partkey % 17 AS VARCHAR) || ' in statement' AS message,
  CASE WHEN l_linestatus = 'O' THEN 'fix it' ELSE '' END AS suggestion, round(1 - 5 * l_discount, 2) AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'local' ELSE 'rule' END AS source,
  'rule-' || CAST(l_partkey % 25 AS VARCHAR) AS rule_id, l_tax AS metric_value FROM lineitem),
ranked AS (SELECT *, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS rnk, coalesce(nullif(category, ''), type) AS kind FROM findings),
reviews AS (SELECT o_orderkey AS review_id, o_custkey % 97 AS project_id, o_orderdate AS started_at, o_orderstatus AS status, o_orderpriority AS author FROM orders),
projects AS (SELECT c_custkey AS project_id, c_name AS name FROM customer WHERE c_custkey < 97),
feedback AS (SELECT event_id, ts, 'rule-' || CAST(user_id AS VARCHAR) AS rule_id,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'modify' WHEN 'view' THEN 'skip' ELSE 'reject' END AS feedback_type,
  CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 <= 2 THEN 'high' WHEN event_id % 7 <= 4 THEN 'medium' ELSE 'low' END AS severity FROM events),
files AS (SELECT doc_id, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path,
  CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'java' WHEN 'fr' THEN 'javascript' ELSE 'go' END AS language, text AS content, lang, source FROM documents),
debt_items AS (SELECT p_partkey AS item_id, CASE WHEN p_size <= 5 THEN 'critical' WHEN p_size <= 15 THEN 'high' WHEN p_size <= 30 THEN 'medium' ELSE 'low' END AS priority,
  CASE p_partkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'resolved' END AS status, CAST(p_size AS DOUBLE) AS estimated_hours FROM part)
"""
LEVEL_COUNTS = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info"
