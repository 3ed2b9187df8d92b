"""Dashboard figures over projects, reviews, findings, debt items and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity


#: Gates are settings; so many are sent to every task at most.
MOST_GATES = 1000

def debt_hours() -> Column:
    return severity.weighted(severity.DEBT_HOURS)


def quality_score(files: Column) -> Column:
    """100 less ten times the weighted findings per file, 0 at least; 100 without files."""
    w = severity.weighted(severity.SCORE_WEIGHTS, 0.5)
    return F.when(files > 0, F.round(F.greatest(F.lit(0.0), 100.0 - 10.0 * w / files), 2)).otherwise(100.0)


def review_score(critical: Column, high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0), 100 - (10 * critical + 5 * high + 2 * medium))


def risk_score() -> Column:
    return severity.weighted(severity.RISK_WEIGHTS, 0)


def review_counters(findings: DataFrame) -> DataFrame:
    """One row a review: findings, files, levels, debt hours, quality and risk."""
    return findings.groupBy("review_id").agg(
        F.count("*").alias("total_findings"), *severity.counts(), F.countDistinct("file_path").alias("files"),
        debt_hours().alias("debt_hours"), quality_score(F.countDistinct("file_path")).alias("quality_score"), risk_score().alias("risk_score"),
    )


def latest(reviews: DataFrame, key: str, *order) -> DataFrame:
    """The last review of each project: a maximum, combined before the shuffle."""
    rest = [c for c in reviews.columns if c != key]
    return reviews.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def overview(projects: DataFrame, reviews: DataFrame, counters: DataFrame) -> DataFrame:
    """One row of totals; missing sums are 0."""
    p = projects.agg(F.count("*").alias("projects"))
    r = reviews.agg(F.count("*").alias("reviews"))
    c = counters.agg(
        F.coalesce(F.sum("total_findings"), F.lit(0)).alias("findings"), F.coalesce(F.avg("total_findings"), F.lit(0.0)).alias("avg_findings"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"), F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
    )
    return p.join(F.broadcast(r)).join(F.broadcast(c))


def trend(series: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Direction of each series: the least-squares slope over its positions, and the rate of improvement.

    Under -0.1 improving, over 0.1 declining, else (or with one point) stable. The rate is the fall
    from first to last in per cent of the first, 0 if that is 0 or alone.
    """
    w = Window.partitionBy(key).orderBy(*order)
    s = series.withColumn("_i", F.row_number().over(w) - 1)
    g = s.groupBy(key).agg(F.count("*").alias("points"), F.regr_slope(F.col(value).cast("double"), F.col("_i").cast("double")).alias("slope"), F.min_by(value, "_i").alias("first"), F.max_by(value, "_i").alias("last"))
    g = g.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    direction = F.when(F.col("points") < 2, "stable").when(F.col("slope") < -0.1, "improving").when(F.col("slope") > 0.1, "declining").otherwise("stable")
    rate = F.when((F.col("points") < 2) | (F.col("first") == 0), 0.0).otherwise((F.col("first") - F.col("last")) / F.col("first") * 100.0)
    return g.withColumn("direction", direction).withColumn("improvement_rate", rate)


def debt_summary(items: DataFrame, status: str | None = None) -> DataFrame:
    """Counts by priority and status and the estimated hours."""
    if status:
        items = items.where(F.col("status") == status)
    of = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    return items.agg(F.count("*").alias("total"), *[of("priority", p) for p in ("critical", "high", "medium", "low")], *[of("status", s) for s in ("open", "in_progress", "resolved")], F.coalesce(F.sum("estimated_hours"), F.lit(0.0)).alias("hours"))


def team_metrics(metrics: DataFrame, start, end) -> DataFrame:
    """Sums by author over periods that lie within the bounds, and the mean quality."""
    m = metrics.where((F.col("period_start") >= F.lit(start)) & (F.col("period_end") <= F.lit(end)))
    sums = [F.sum(c).cast("long").alias(c) for c in ("reviews", "introduced", "fixed", "lines_added", "lines_removed")]
    return m.groupBy("author").agg(*sums, F.avg("quality").alias("quality"))


def quality_gates(gates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each gate on each review: passed, and the violations in order.

    Gates are a short list of settings and are sent to every task; a null threshold is not checked.
    """
    if gates.count() > MOST_GATES:
        raise ValueError(f"more than {MOST_GATES} gates: these are settings, not data")
    r = reviews.join(F.broadcast(gates))
    over = lambda c, m, name: F.when(F.col(c) > F.col(m), F.lit(name))
    v = F.array_compact(F.array(over("critical", "max_critical", "critical"), over("high", "max_high", "high"), over("total_findings", "max_total", "total"), over("debt_hours", "max_debt_hours", "debt"), F.when(F.col("quality_score") < F.col("min_quality"), "quality")))
    return r.withColumn("violations", v).withColumn("passed", F.size("violations") == 0)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def tech_debt_minutes(findings: DataFrame) -> DataFrame:
    """Minutes for each finding by kind, doubled for blockers, half as much again for critical security."""
    base = F.when(F.col("type") == "security", 60.0).when(F.col("type") == "performance", 30.0).otherwise(15.0)
    factor = F.when((F.col("type") == "security") & (F.col("severity") == "critical"), 1.5).otherwise(1.0)
    return findings.withColumn("minutes", base * factor)


def sqale(minutes: Column, loc: Column) -> tuple[Column, Column]:
    """Debt ratio (minutes over half a minute a line) and its rating."""
    ratio = F.when(loc > 0, F.round(minutes / (loc * 0.5), 4)).otherwise(0.0)
    return ratio, F.when(ratio <= 0.05, "A").when(ratio <= 0.1, "B").when(ratio <= 0.2, "C").when(ratio <= 0.5, "D").otherwise("E")
