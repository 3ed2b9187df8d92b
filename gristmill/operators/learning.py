"""Learning from feedback: rates by rule, adjustments, and findings rewritten by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity


def _of(kind: str):
    return F.count_if(F.coalesce(F.col("feedback_type") == kind, F.lit(False)))


def feedback_stats(feedback: DataFrame, *keys: str) -> DataFrame:
    """Counts of each kind and the shares accepted and rejected (0 without feedback)."""
    g = feedback.groupBy(*keys).agg(F.count("*").alias("total"), *[_of(k).alias(k) for k in ("accept", "reject", "modify", "skip")])
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return g.withColumn("accept_rate", share("accept")).withColumn("reject_rate", share("reject"))


def false_positive_rules(feedback: DataFrame, least: float = 0.5) -> DataFrame:
    """Rules rejected in at least this share, however little feedback there is."""
    g = feedback.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("total"), _of("reject").alias("rejects"))
    return g.withColumn("rate", F.col("rejects") / F.col("total")).where(F.col("rate") >= least)


def rule_adjustments(feedback: DataFrame, least: int = 5) -> DataFrame:
    """For rules with enough feedback: whether to suppress, a new severity, a factor on confidence.

    Suppressed from 60 % rejected; a step down under 30 % accepted, up over 80 %; factor 1.2 over 80 %
    accepted, 0.7 from 50 % rejected. The present severity is the most frequent one, the first by name
    of equals, medium without any.
    """
    g = feedback.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("total"), _of("accept").alias("accepts"), _of("reject").alias("rejects"), F.expr("mode(severity, true)").alias("mode"))
    return adjusted(g, least)


def adjusted(g: DataFrame, least: int) -> DataFrame:
    """Adjustments from counts: ``rule_id, total, accepts, rejects, mode`` (the most frequent severity)."""
    g = g.where(F.col("total") >= least).withColumn("accept_rate", F.col("accepts") / F.col("total")).withColumn("reject_rate", F.col("rejects") / F.col("total"))
    now = F.coalesce("mode", F.lit("medium"))
    new = F.when(F.col("accept_rate") < 0.3, severity.shift(now, -1)).when(F.col("accept_rate") > 0.8, severity.shift(now, 1)).otherwise(now)
    factor = F.when(F.col("accept_rate") > 0.8, 1.2).when(F.col("reject_rate") >= 0.5, 0.7).otherwise(1.0)
    return g.select("rule_id", "total", "accept_rate", "reject_rate", (F.col("reject_rate") >= 0.6).alias("suppress"), now.alias("original_severity"), new.alias("adjusted_severity"), factor.alias("multiplier"))


def apply_learning(findings: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Findings of suppressed rules go; others take their rule's severity and confidence factor (at most 100).

    One row a rule: Spark sends the adjustments to all tasks if they are small enough for its own
    threshold, and shuffles otherwise.
    """
    a = adjustments.select("rule_id", "suppress", "adjusted_severity", "multiplier")
    out = findings.join(a, "rule_id", "left").where("NOT coalesce(suppress, false)")
    changed = F.coalesce(F.col("adjusted_severity") != F.col("severity"), F.lit(False))
    out = out.withColumn("original_severity", F.when(changed, F.col("severity")))
    out = out.withColumn("severity", F.coalesce("adjusted_severity", "severity"))
    out = out.withColumn("confidence", F.when(F.col("multiplier").isNull(), F.col("confidence")).otherwise(F.least(F.lit(100.0), F.col("confidence") * F.col("multiplier"))))
    return out.drop("suppress", "adjusted_severity", "multiplier")


def learning_stats(adjustments: DataFrame) -> DataFrame:
    return adjustments.agg(F.count("*").alias("rules"), F.count_if("suppress").alias("suppressed"), F.count_if(F.col("original_severity") != F.col("adjusted_severity")).alias("adjusted"), F.round(F.avg("accept_rate"), 6).alias("accept_rate"))


def recommendations(adjustments: DataFrame) -> DataFrame:
    """What to look at: rules rejected in half the cases or more, and rules accepted in under 30 %."""
    noisy = adjustments.where("reject_rate >= 0.5").select("rule_id", F.lit("review-or-disable").alias("advice"), F.col("reject_rate").alias("rate"))
    weak = adjustments.where("accept_rate < 0.3").select("rule_id", F.lit("lower-severity").alias("advice"), F.col("accept_rate").alias("rate"))
    return noisy.unionByName(weak)
