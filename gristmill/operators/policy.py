"""Policies: which apply, what they find wrong, and whether they block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex, severity


def severity_rule(findings: DataFrame, key: str, max_critical: int | None = 0, max_high: int | None = None, max_medium: int | None = None) -> DataFrame:
    """``key, rule, found, allowed`` for each level with more findings than allowed."""
    c = findings.groupBy(key).agg(*severity.counts())
    limits = {"critical": max_critical, "high": max_high, "medium": max_medium}
    parts = [F.when(F.col(k) > m, F.struct(F.lit(f"severity-{k}").alias("rule"), F.col(k).alias("found"), F.lit(m).cast("long").alias("allowed"))) for k, m in limits.items() if m is not None]
    return c.select(key, F.explode(F.array_compact(F.array(*parts))).alias("v")).select(key, "v.*")


def pattern_rule(findings: DataFrame, key: str, patterns: list[str], most: int = 0) -> DataFrame:
    """``key, found`` where more than ``most`` findings are in files that fit a pattern (prefix form)."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | regex.prefix_glob("file_path", p)
    return findings.groupBy(key).agg(F.count_if(fits).alias("found")).where(F.col("found") > most)


def metric_rule(findings: DataFrame, most: float, category: str = "complexity") -> DataFrame:
    """Findings of a category whose metric is above the limit."""
    return findings.where((F.col("category") == category) & (F.col("metric_value") > most))


def custom_rule(findings: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A rule of one's own: findings to violations."""
    return evaluate(findings)


def fits_files(files: Column, include: Column, exclude: Column) -> Column:
    """Whether some file of an array fits a pattern of ``include``, any if it has none, and no pattern of ``exclude``; arrays of shell patterns, null is none."""
    some = lambda patterns, f: F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: regex.glob_of(f, p))
    any_at_all = F.coalesce(F.size(include), F.lit(0)) <= 0
    return F.exists(files, lambda f: (any_at_all | some(include, f)) & ~some(exclude, f))


def applicable(policies: DataFrame, scope: str, branch: str | None = None, files: list[str] | None = None) -> DataFrame:
    """Enabled policies of a scope that include the branch, do not exclude it, and fit some file.

    Patterns are the columns ``file_patterns`` and ``exclude_patterns``, if there; without patterns, or without files, a policy fits.
    """
    p = policies.where(F.col("enabled") & F.array_contains("scope", scope))
    if branch is not None:
        p = p.where((F.size("branches") <= 0) | F.array_contains("branches", branch)).where(~F.array_contains("exclude_branches", branch))
    if files:
        include, exclude = (F.col(c) if c in policies.columns else F.array().cast("array<string>") for c in ("file_patterns", "exclude_patterns"))
        p = p.where(fits_files(F.array(*[F.lit(f) for f in files]), include, exclude))
    return p.orderBy(F.desc("priority"), "id")


def approvals(violations: DataFrame, policies: DataFrame) -> DataFrame:
    """Whose approval the violated policies ask for: ``id, violations, requires_approval, teams, roles, approvers, warns``.

    ``policies`` may have arrays ``required_teams`` and ``required_roles`` and a number ``required_approvers``; only policies whose action is
    require_approval ask. ``warns``: the action is warn, or the policy only advises.
    """
    have = set(policies.columns)
    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    asks = F.col("action") == "require_approval"
    none = F.array().cast("array<string>")
    v = violations.groupBy("policy_id").agg(F.count("*").alias("violations"))
    out = policies.join(v, policies["id"] == v["policy_id"])
    number = F.coalesce(F.col("required_approvers"), F.lit(1)) if "required_approvers" in have else F.lit(1)
    return out.select(
        "id", "violations", asks.alias("requires_approval"), F.when(asks, F.array_sort(names("required_teams"))).otherwise(none).alias("teams"), F.when(asks, F.array_sort(names("required_roles"))).otherwise(none).alias("roles"),
        F.when(asks, number).otherwise(0).cast("int").alias("approvers"), ((F.col("action") == "warn") | (F.col("enforcement") == "advisory")).alias("warns"),
    )


def verdicts(violations: DataFrame, policies: DataFrame) -> DataFrame:
    """Each policy's number of violations, whether it blocks and whether it may be overridden.

    A policy blocks if its action is block and its enforcement strict; a flexible one may be overridden.
    """
    v = violations.groupBy("policy_id").agg(F.count("*").alias("violations"))
    out = policies.join(v, policies["id"] == v["policy_id"], "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    flexible = F.col("enforcement") == "flexible"
    return out.select("id", "action", "enforcement", "violations", (F.col("violations") == 0).alias("passed"), ((F.col("violations") > 0) & (F.col("action") == "block") & (F.col("enforcement") == "strict")).alias("blocks"), ((F.col("violations") > 0) & flexible).alias("can_override"))


def any_file(files: str, include: list[str], exclude: list[str] | None = None):
    """Whether some file of an array column fits an included pattern and no excluded one."""
    return F.exists(files, lambda f: _fits(f, include) & ~_fits(f, exclude or []))


def _fits(f, patterns: list[str]):
    found = F.lit(False)
    for p in patterns:
        found = found | regex.glob(f, p)
    return found


def compliance(results: DataFrame, scope) -> DataFrame:
    """Evaluations, passes and their share in per cent by scope; ``results`` has ``passed``."""
    return results.groupBy(scope).agg(F.count("*").alias("evaluations"), F.count_if("passed").alias("passed"), F.round(100.0 * F.count_if("passed") / F.count("*"), 4).alias("compliance"))


# Ready-made policies by name.
TEMPLATES = {
    "strict-security": {"action": "block", "enforcement": "strict", "max_critical": 0, "max_high": 0},
    "balanced": {"action": "block", "enforcement": "flexible", "max_critical": 0, "max_high": 5},
    "advisory": {"action": "warn", "enforcement": "advisory", "max_critical": 5, "max_high": 20},
    "security-critical": {"scope": ["pre-commit", "pull-request"], "action": "block", "enforcement": "strict", "max_critical": 0, "max_high": 0},
    "production-ready": {"scope": ["pull-request", "merge"], "action": "block", "enforcement": "strict", "max_critical": 0, "max_high": 0, "max_medium": 5, "max_complexity": 15, "min_coverage": 0.8, "branches": ["main", "master", "production"]},
    "security-review-required": {"scope": ["pull-request"], "action": "require_approval", "enforcement": "strict", "file_patterns": ["**/auth/**", "**/security/**", "**/crypto/**"], "required_approvers": 1, "required_teams": ["security"]},
    "architecture-review": {"scope": ["pull-request"], "action": "require_approval", "enforcement": "flexible", "file_patterns": ["**/core/**", "**/api/**", "**/database/**"], "required_approvers": 1, "required_roles": ["architect", "tech-lead"]},
    "quality-gate": {"scope": ["pull-request"], "action": "warn", "enforcement": "advisory", "max_critical": 0, "max_high": 3, "max_medium": 10, "max_complexity": 20},
}


def from_templates(spark, names: list[str] | None = None) -> DataFrame:
    """Ready-made policies as a table that the functions here take, all of them or those named."""
    schema = "id string, enabled boolean, priority int, scope array<string>, action string, enforcement string, branches array<string>, exclude_branches array<string>, file_patterns array<string>, exclude_patterns array<string>, max_critical int, max_high int, max_medium int, max_complexity int, min_coverage double, required_approvers int, required_teams array<string>, required_roles array<string>"
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    rest = {"enabled": True, "priority": 0}
    rows = [tuple({"id": n, **rest, **TEMPLATES[n]}.get(c, [] if "array" in kind else None) for c, kind in fields) for n in (names or TEMPLATES)]
    return spark.createDataFrame(rows, schema)


def load_policies(text: str, form: str = "yaml") -> list[dict]:
    """Policies of a YAML or JSON text with a list ``policies``; id, name and action must be there."""
    import json

    if form == "json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    out = []
    for p in (data or {}).get("policies", []):
        missing = [k for k in ("id", "name", "action") if not p.get(k)]
        if missing:
            raise ValueError(f"policy without {', '.join(missing)}")
        out.append({"enabled": True, "priority": 0, "scope": [], "branches": [], "exclude_branches": [], "enforcement": "strict", **p})
    return sorted(out, key=lambda p: (-p["priority"], p["id"]))


# Rules that are always there, by id, with their kind and limits.
DEFAULT_RULES = {
    "severity-strict": {"kind": "severity", "max_critical": 0, "max_high": 0, "max_medium": 5, "max_low": 20},
    "severity-moderate": {"kind": "severity", "max_critical": 0, "max_high": 3, "max_medium": 10, "max_low": 50},
    "security-zero-tolerance": {"kind": "security", "max_issues": 0, "severity": "critical"},
    "security-moderate": {"kind": "security", "max_issues": 3, "severity": "high"},
    "complexity-strict": {"kind": "complexity", "max_complexity": 10, "severity": "high"},
    "complexity-moderate": {"kind": "complexity", "max_complexity": 15, "severity": "medium"},
    "security-files-zero-issues": {"kind": "files", "patterns": ["**/auth/**", "**/security/**", "**/crypto/**"], "max_issues": 0, "severity": "critical"},
    "api-files-low-issues": {"kind": "files", "patterns": ["**/api/**", "**/endpoints/**"], "max_issues": 3, "severity": "high"},
    "coverage-80": {"kind": "coverage", "min_coverage": 0.8, "severity": "medium"},
    "coverage-90": {"kind": "coverage", "min_coverage": 0.9, "severity": "high"},
}


def default_rules():
    """Ids of the default rules that a policy's settings ask for, as an array column.

    Reads max_critical, max_high, max_complexity, min_coverage and file_patterns (an array); a null asks for nothing.
    """
    given = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    no_critical = F.coalesce(F.col("max_critical") == 0, F.lit(False))
    names = F.coalesce(F.array_join("file_patterns", " "), F.lit(""))
    return F.array_compact(F.array(
        F.when(no_critical & F.coalesce(F.col("max_high") == 0, F.lit(False)), "severity-strict").otherwise("severity-moderate"),
        F.when(no_critical, "security-zero-tolerance"),
        F.when(given("max_complexity"), F.when(F.col("max_complexity") <= 10, "complexity-strict").otherwise("complexity-moderate")),
        F.when(given("min_coverage"), F.when(F.col("min_coverage") >= 0.9, "coverage-90").when(F.col("min_coverage") >= 0.8, "coverage-80")),
        F.when(names.rlike("auth|security|crypto"), "security-files-zero-issues"), F.when(names.rlike("api|endpoints"), "api-files-low-issues"),
    ))


def registry(spark, rules: dict[str, dict] | None = None) -> DataFrame:
    """``rule_id, kind, limits`` (JSON) of the default rules and of one's own."""
    import json

    rows = [(k, r["kind"], json.dumps({x: v for x, v in r.items() if x != "kind"}, sort_keys=True)) for k, r in (DEFAULT_RULES | (rules or {})).items()]
    return spark.createDataFrame(rows, "rule_id string, kind string, limits string")


def rules_of(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """Each policy's rules with their limits, in the order it names them; ids that no rule has are passed over."""
    named = policies.select(F.col("id").alias("policy_id"), F.posexplode("rules").alias("position", "rule_id"))
    return named.join(rules, "rule_id").select("policy_id", "position", "rule_id", "kind", "limits")


def dump_policies(policies: list[dict], form: str = "yaml") -> str:
    """The text that ``load_policies`` reads back."""
    import json

    data = {"policies": sorted(policies, key=lambda p: (-p.get("priority", 0), p["id"]))}
    if form == "json":
        return json.dumps(data, indent=2, sort_keys=True)
    import yaml

    return yaml.safe_dump(data, sort_keys=True)


def import_policies(known: list[dict], text: str, form: str = "yaml", replace: bool = False) -> list[dict]:
    """``known`` and the policies of a text; of two with one id the known one stays, or goes with ``replace``."""
    new = {p["id"]: p for p in load_policies(text, form)}
    old = {p["id"]: p for p in known}
    both = old | new if replace else new | old
    return sorted(both.values(), key=lambda p: (-p.get("priority", 0), p["id"]))
