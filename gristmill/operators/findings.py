"""Algebra of findings: filters, deduplication, priorities, groups, caps."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import merge

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex, severity


def kind() -> Column:
    """The category of a finding, its type where that is missing or empty."""
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("type"))


def filter_findings(findings: DataFrame, min_severity: str | None = None, max_severity: str | None = None, min_confidence: float | None = None, categories: Sequence[str] | None = None, file_patterns: Sequence[str] | None = None) -> DataFrame:
    """Findings within all the given bounds; an unknown bound is an error, an unknown severity fits none."""
    for bound in (min_severity, max_severity):
        if bound is not None and bound not in severity.LEVELS:
            raise ValueError(f"unknown severity {bound!r}")
    if min_severity:
        findings = findings.where(severity.rank() >= severity.LEVELS.index(min_severity))
    if max_severity:
        findings = findings.where(severity.rank() <= severity.LEVELS.index(max_severity))
    if min_confidence is not None:
        findings = findings.where(F.col("confidence") >= min_confidence)
    if categories:
        findings = findings.where(F.col("category").isin(*categories) | F.col("type").isin(*categories))
    if file_patterns:
        fits = F.lit(False)
        for p in file_patterns:
            fits = fits | regex.glob("file_path", p)
        findings = findings.where(fits)
    return findings


def at_least(findings: DataFrame, least: str) -> DataFrame:
    """Findings of a severity or worse; unknown severities stay."""
    return findings.where(severity.rank(unknown=99) >= severity.LEVELS.index(least))


def confident(findings: DataFrame, least: float = 0.5, source: str = "llm") -> DataFrame:
    """Findings of one source need this confidence; those of others stay."""
    return findings.where((F.col("source") != source) | (F.col("confidence") >= least))


def accepted_only(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings whose place was accepted."""
    accepted = decisions.where("decision = 'accept'").select("file_path", "line_start").distinct()
    return findings.join(accepted, ["file_path", "line_start"], "left_semi")


def dedup_exact(findings: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first finding, by ``order``, of each place, severity and message head (50 characters).

    Aggregated as a minimum, so that the rows of a frequent signature combine before the shuffle.
    """
    rest = [c for c in findings.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    signature = [F.col("file_path").alias("_f"), F.col("line_start").alias("_l"), F.col("severity").alias("_s"), F.substring("message", 1, 50).alias("_m")]
    return findings.groupBy(*signature).agg(first).select(*[F.col(f"first.{c}").alias(c) for c in findings.columns])


#: Pieces of a file that are folded together.
PIECES = 64


def dedup_similar(findings: DataFrame, order: Sequence[str], lines: int = 5, ratio: float = 0.85) -> DataFrame:
    """Exact duplicates go first; then, in ``order``, a finding that resembles one kept before it goes.

    Alike: same file and severity, at most ``lines`` apart, and messages whose matching blocks make
    ``ratio`` of their length. If the later one is surer, it takes the earlier one's place, at the end
    of the order. Only findings of one file and severity on near lines can be alike: a file is cut where
    the next line with any is more than ``lines`` away, some dozens of pieces go together, and each finding
    meets only what is kept on the lines around it. A finding without a line is like no other.
    """
    from difflib import SequenceMatcher

    once = dedup_exact(findings, order)
    place = Window.partitionBy("file_path", "severity").orderBy("line_start")
    far = F.coalesce(F.col("line_start") - F.lag("line_start").over(place) > lines, F.lit(False))
    placed = once.withColumn("_far", far.cast("int")).withColumn("_piece", F.floor(F.sum("_far").over(place) / PIECES)).drop("_far")
    names = once.columns

    def fold(group: pa.Table) -> pa.Table:
        kept: dict[int, list[tuple[int, int]]] = {}  # by line: when it was kept, and which; in that order
        known: dict[tuple[str, str], bool] = {}  # findings of a file repeat few messages

        def alike(a: str, b: str) -> bool:
            if (a, b) not in known:
                m = SequenceMatcher(None, a, b)
                known[a, b] = a == b or m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio
            return known[a, b]

        group = group.take(pc.sort_indices(group, [(c, "ascending") for c in order])).select(names)
        at, said, sure = (group.column(c).to_pylist() for c in ("line_start", "message", "confidence"))
        said = [(x or "").lower() for x in said]
        for i, line in enumerate(at):
            near = merge(*(kept[x] for x in range(line - lines, line + lines + 1) if x in kept)) if line is not None else ()
            twin = next(((when, k) for when, k in near if alike(said[k], said[i])), None)
            if twin is None or sure[i] is not None and sure[twin[1]] is not None and sure[i] > sure[twin[1]]:
                if twin is not None:
                    kept[at[twin[1]]].remove(twin)
                kept.setdefault(line, []).append((i, i))
        return group.take(pa.array([k for _, k in merge(*kept.values())], pa.int64()))

    return placed.groupBy("file_path", "severity", "_piece").applyInArrow(fold, once.schema)


def priority(findings: DataFrame) -> DataFrame:
    """Adds ``priority_score`` (at most 100) and ``reasons``."""
    weight = severity.case("severity", severity.PRIORITY_WEIGHTS, 50.0)
    by_kind = severity.case(kind(), severity.CATEGORY_WEIGHTS, 1.0)
    sure = F.when(F.col("confidence") >= 0.9, 1.2).when(F.col("confidence") >= 0.8, 1.1).otherwise(1.0)
    helped = F.coalesce(F.col("suggestion") != "", F.lit(False))
    secure = F.coalesce((F.col("type") == "security") | (kind() == "security"), F.lit(False))
    score = weight * by_kind * sure * F.when(helped, 1.15).otherwise(1.0) * F.when(secure, 1.3).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.concat(F.col("severity"), F.lit(" severity")), F.when(by_kind > 1.0, F.concat(kind(), F.lit(" category (high priority)"))),
        F.when(F.col("confidence") >= 0.9, "high confidence (≥90%)").when(F.col("confidence") >= 0.8, "good confidence (≥80%)"),
        F.when(helped, "has actionable suggestion"), F.when(secure, "security-related"),
    ))
    return findings.withColumn("priority_score", F.least(score, F.lit(100.0))).withColumn("reasons", reasons)


def by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of the five levels, by ``keys`` or over all."""
    return findings.groupBy(*keys).agg(*severity.counts())


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy(kind().alias("kind")).agg(F.count("*").alias("findings"))


def by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file in the order of their lines."""
    return findings.groupBy("file_path").agg(F.count("*").alias("findings"), F.array_sort(F.collect_list("line_start")).alias("lines"))


def summary(findings: DataFrame) -> DataFrame:
    """Totals of one review in one row."""
    return findings.agg(
        F.count("*").alias("total"), *severity.counts(),
        F.count_if(F.col("severity").isin("critical", "high") & (F.col("confidence") >= 0.8)).alias("high_confidence_critical"),
        F.count_if(F.coalesce(F.col("suggestion") != "", F.lit(False))).alias("actionable"),
        F.countDistinct("file_path").alias("files"), F.coalesce(F.bool_or(F.col("severity").isin("critical", "high")), F.lit(False)).alias("has_critical"),
    )


def top_files(findings: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` files with most findings; the one that comes first wins a tie."""
    files = findings.groupBy("file_path").agg(F.count("*").alias("findings"), F.min(F.struct(*order)).alias("_first"))
    return files.orderBy(F.desc("findings"), "_first", "file_path").limit(n).drop("_first")


def cap(findings: DataFrame, keys: Sequence[str], most: int, order: Sequence) -> DataFrame:
    """At most ``most`` findings of each key, first by ``order``; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Worst first, unknown severities last; then by line and category."""
    return findings.orderBy(F.desc(severity.rank(unknown=-1)), "line_start", "category")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All findings of all sources; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def ci_status(findings: DataFrame, fail_on_critical: bool = True, high_threshold: int = 5) -> DataFrame:
    """One row: FAILURE with a critical finding, or more high ones than allowed, else SUCCESS."""
    c = findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    bad = (F.lit(fail_on_critical) & (F.col("critical") > 0)) | (F.lit(high_threshold > 0) & (F.col("high") > high_threshold))
    return c.withColumn("state", F.when(bad, "FAILURE").otherwise("SUCCESS"))


def fingerprint() -> Column:
    """Sixteen hex digits of place and message."""
    return F.substring(F.md5(F.concat_ws(":", "file_path", F.col("line_start").cast("string"), "message")), 1, 16)
