"""Rule engine: a rule table becomes one array expression per text, exploded into findings.

No text x rule join: each rule is a branch of one projection, guarded by its languages, with its
pattern as a literal, so a text is read in place and rows appear for matches only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regex


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    severity: str
    message: str
    suggestion: str | None = None
    languages: tuple[str, ...] | None = None
    enabled: bool = True
    case_sensitive: bool = True
    multiline: bool = False
    cwe: str | None = None
    owasp: str | None = None
    description: str = field(default="", compare=False)

    def java_pattern(self) -> str:
        return regex.flags(self.pattern, not self.case_sensitive, self.multiline, self.multiline)


# The default rules.
DEFAULT_RULES = (
    Rule("no-hardcoded-secrets", "No Hardcoded Secrets", r"""(?:api[_-]?key|password|secret|token)\s*[=:]\s*["'][\w\-]{20,}["']""", "critical", "Potential hardcoded secret detected", "Use environment variables or a secrets management system", case_sensitive=False),
    Rule("no-todo-comments", "No TODO Comments", r"//\s*TODO:|#\s*TODO:", "info", "TODO comment found", "Create a ticket to track this work", case_sensitive=False),
    Rule("no-fixme-comments", "No FIXME Comments", r"//\s*FIXME:|#\s*FIXME:", "medium", "FIXME comment found", "Address this issue before merging", case_sensitive=False),
    Rule("no-debugger", "No Debugger Statements", r"\bdebugger\s*;", "high", "Debugger statement found", "Remove debugger statements before committing", ("javascript", "typescript")),
    Rule("no-print-statements", "No Print Statements", r"\bprint\s*\(", "info", "Print statement found", "Use logging instead of print statements", ("python",)),
    Rule("no-eval", "No Eval Usage", r"\beval\s*\(", "critical", "Dangerous eval() usage detected", "Avoid eval() as it can execute arbitrary code"),
    Rule("no-sql-concat", "No SQL String Concatenation", r"(?:SELECT|INSERT|UPDATE|DELETE).*\+.*(?:WHERE|VALUES)", "critical", "Potential SQL injection via string concatenation", "Use parameterized queries or an ORM", case_sensitive=False),
    Rule("no-weak-crypto", "No Weak Cryptography", r"\b(?:MD5|SHA1|DES)\b", "high", "Weak cryptographic algorithm detected", "Use SHA-256 or stronger algorithms", case_sensitive=False),
)
# The static-analysis rules with weakness and risk class.
SAST_RULES = (
    Rule("SAST-001", "SQL Injection via String Concatenation", r"(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\+", "critical", "SQL query constructed using string concatenation with user input", None, ("python", "javascript", "typescript", "java", "php"), case_sensitive=False, cwe="CWE-89", owasp="A03:2021"),
    Rule("SAST-002", "Cross-Site Scripting (XSS)", r"(innerHTML|outerHTML|document\.write)\s*=", "high", "Unescaped user input rendered in HTML", None, ("javascript", "typescript"), case_sensitive=False, cwe="CWE-79", owasp="A03:2021"),
    Rule("SAST-003", "OS Command Injection", r"(os\.system|subprocess\.call|exec|eval|shell_exec)\s*\(.*\+", "critical", "OS command executed with user-controlled input", None, ("python", "javascript", "typescript", "php"), case_sensitive=False, cwe="CWE-78", owasp="A03:2021"),
    Rule("SAST-004", "Path Traversal", r"(open|read|readFile|File)\s*\(.*\+", "high", "File path constructed with user input without validation", None, ("python", "javascript", "typescript", "java"), case_sensitive=False, cwe="CWE-22", owasp="A01:2021"),
    Rule("SAST-005", "Hard-coded Credentials", r"""(password|passwd|pwd|api_key|apikey|secret|token)\s*=\s*["'][^"']{8,}["']""", "critical", "Hard-coded password or API key detected", None, ("python", "javascript", "typescript", "java", "go", "rust"), case_sensitive=False, cwe="CWE-798", owasp="A07:2021"),
    Rule("SAST-006", "Weak Cryptographic Algorithm", r"(MD5|SHA1|DES|RC4|ECB)\s*\(", "high", "Use of weak or deprecated cryptographic algorithm", None, ("python", "javascript", "typescript", "java", "go"), case_sensitive=False, cwe="CWE-327", owasp="A02:2021"),
    Rule("SAST-007", "Insecure Deserialization", r"(pickle\.loads|yaml\.load|unserialize|ObjectInputStream)\s*\(", "critical", "Deserialization of untrusted data", None, ("python", "java", "php"), case_sensitive=False, cwe="CWE-502", owasp="A08:2021"),
    Rule("SAST-008", "Server-Side Request Forgery (SSRF)", r"(requests\.get|fetch|urllib\.request|http\.get)\s*\(.*\+", "high", "HTTP request with user-controlled URL", None, ("python", "javascript", "typescript"), case_sensitive=False, cwe="CWE-918", owasp="A10:2021"),
    Rule("SAST-009", "XML External Entity (XXE)", r"(XMLParser|DocumentBuilder|SAXParser).*(?!.*setFeature.*disallow)", "high", "XML parser configured to process external entities", None, ("python", "java"), case_sensitive=False, cwe="CWE-611", owasp="A05:2021"),
    Rule("SAST-010", "Missing CSRF Protection", r"@(app\.route|post|put|delete).*(?!.*csrf)", "medium", "Form or state-changing endpoint without CSRF protection", None, ("python",), case_sensitive=False, cwe="CWE-352", owasp="A01:2021"),
)


def fits_language(r: Rule, column: str):
    """Whether a rule is for a language, whatever the letters' case; without languages it is for all."""
    return F.lower(column).isin(*[x.lower() for x in r.languages]) if r.languages else F.lit(True)


def _finding(r: Rule):
    """A match as a finding of the rule."""
    fixed = [F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.suggestion).cast("string").alias("suggestion")]
    return lambda m: F.struct(*fixed, m["line"].cast("long").alias("line_start"), m["col"].cast("long").alias("col"), m["text"].alias("matched"))


class RulesEngine:
    """A set of rules by id, and what it finds in texts."""

    def __init__(self, rules: Iterable[Rule] = DEFAULT_RULES) -> None:
        self.rules: dict[str, Rule] = {r.id: r for r in rules}

    def add(self, rule: Rule) -> None:
        self.rules[rule.id] = rule

    def remove(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def enable(self, rule_id: str, on: bool = True) -> bool:
        if rule_id not in self.rules:
            return False
        self.rules[rule_id] = Rule(**{**asdict(self.rules[rule_id]), "enabled": on, "languages": self.rules[rule_id].languages})
        return True

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.id, r.name, r.pattern, r.severity, r.message, r.suggestion, list(r.languages) if r.languages else None, r.enabled, r.cwe, r.owasp) for r in self.rules.values()]
        return spark.createDataFrame(rows, "id string, name string, pattern string, severity string, message string, suggestion string, languages array<string>, enabled boolean, cwe string, owasp string")

    def scan(self, files: DataFrame, text: str = "content", keep: tuple[str, ...] = ("file_path", "language")) -> DataFrame:
        """Findings: the ``keep`` columns, rule_id, severity, message, suggestion, line_start, col, matched.

        ``files`` has ``keep`` (with language) and ``text``. A rule without languages fits all; a
        missing language fits only those.
        """
        parts = []
        for r in self.rules.values():
            if not r.enabled:
                continue
            found = regex.matches(text, r.java_pattern())
            made = F.transform(found, _finding(r))
            if r.languages:
                made = F.when(fits_language(r, "language"), made)
            parts.append(F.coalesce(made, F.expr("cast(array() AS array<struct<rule_id:string,severity:string,message:string,suggestion:string,line_start:bigint,col:bigint,matched:string>>)")))
        return files.select(*keep, F.explode(F.concat(*parts)).alias("m")).select(*keep, "m.*")


def load_rules(text: str, form: str = "yaml") -> list[Rule]:
    """Rules of a YAML or JSON text with a list ``rules``; id, name, pattern and message must be there."""
    if form == "json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if not isinstance(data, dict) or not isinstance(data.get("rules"), list):
        raise ValueError("a rule file needs a list 'rules'")
    out = []
    for r in data["rules"]:
        missing = [k for k in ("id", "name", "pattern", "message") if not r.get(k)]
        if missing:
            raise ValueError(f"rule without {', '.join(missing)}")
        known = {k: r[k] for k in ("id", "name", "pattern", "message", "suggestion", "enabled", "case_sensitive", "multiline", "description") if k in r}
        out.append(Rule(**known, severity=r.get("severity", "medium"), languages=tuple(r["languages"]) if r.get("languages") else None))
    return out


def statistics(rules: DataFrame) -> DataFrame:
    """One row: rules in all, enabled, disabled, and by severity."""
    from ..functions.severity import counts

    return rules.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"), *counts())


def coverage(rules: DataFrame) -> DataFrame:
    """Rules of each risk class."""
    return rules.where("owasp IS NOT NULL").groupBy("owasp").agg(F.count("*").alias("rules"))
