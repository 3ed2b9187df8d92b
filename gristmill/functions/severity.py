"""Severity as an ordinal, and the maps that hang on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in rising order, and what each one weighs.
LEVELS = ("info", "low", "medium", "high", "critical")
PRIORITY_WEIGHTS = {"critical": 100.0, "high": 75.0, "medium": 50.0, "low": 25.0, "info": 10.0}
CATEGORY_WEIGHTS = {"security": 1.5, "performance": 1.3, "correctness": 1.2, "maintainability": 1.0, "style": 0.8}
DEBT_HOURS = {"critical": 8.0, "high": 4.0, "medium": 2.0, "low": 1.0, "info": 0.5}
SCORE_WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0}
RISK_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORES = {"critical": "9.0", "high": "7.0", "medium": "5.0", "low": "3.0", "info": "1.0"}


def case(column: Column | str, values: dict, otherwise=None) -> Column:
    """``values`` as one CASE expression."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def rank(column: Column | str = "severity", unknown: int | None = None) -> Column:
    """0 for info to 4 for critical."""
    return case(column, {s: k for k, s in enumerate(LEVELS)}, unknown)


def shift(column: Column | str, steps: int) -> Column:
    """One step up or down, held at the ends; unknown severities stay."""
    c = F.col(column) if isinstance(column, str) else column
    moved = {s: LEVELS[min(max(k + steps, 0), len(LEVELS) - 1)] for k, s in enumerate(LEVELS)}
    return F.coalesce(case(c, moved), c)


def counts(column: str = "severity", prefix: str = "") -> list[Column]:
    """A count of each level, worst first; unknown severities are in none."""
    return [F.count_if(F.coalesce(F.col(column) == s, F.lit(False))).alias(f"{prefix}{s}") for s in reversed(LEVELS)]


def weighted(values: dict, otherwise=0.0, column: str = "severity") -> Column:
    """Sum of the weights of a group's severities, 0 without any."""
    return F.coalesce(F.sum(case(column, values, otherwise)), F.lit(0.0 if isinstance(otherwise, float) else 0))


def cvss_severity(score: Column) -> Column:
    """Severity of a CVSS base score."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").otherwise("low")
