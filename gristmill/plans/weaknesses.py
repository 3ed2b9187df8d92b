"""A table of weaknesses: id, name, severity, and the languages they are looked for in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
WEAKNESSES = (
    ("CWE-89", "SQL Injection", "critical"), ("CWE-79", "Cross-Site Scripting (XSS)", "critical"), ("CWE-78", "Command Injection", "critical"), ("CWE-22", "Path Traversal", "high"),
    ("CWE-502", "Insecure Deserialization", "critical"), ("CWE-327", "Weak Cryptography", "high"), ("CWE-798", "Hardcoded Credentials", "critical"), ("CWE-287", "Authentication Bypass", "critical"),
    ("CWE-918", "Server-Side Request Forgery (SSRF)", "high"), ("CWE-362", "Race Condition / TOCTOU", "medium"), ("CWE-611", "XML External Entity (XXE)", "high"), ("CWE-90", "LDAP Injection", "high"),
    ("CWE-601", "Open Redirect", "medium"), ("CWE-352", "Cross-Site Request Forgery (CSRF)", "medium"), ("CWE-338", "Insecure Randomness", "medium"),
)


def weaknesses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEAKNESSES), "cwe string, name string, severity string")
