"""The engine's tables as Parquet folders: append, update, read, export, and the views that the dashboard asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changing import ChangingTable

# The tables and their columns.
SCHEMAS = {
    "projects": "project_id long, name string, created_at timestamp_ntz",
    "reviews": "review_id long, project_id long, started_at timestamp_ntz, status string, author string",
    "findings": "finding_id string, review_id long, severity string, type string, category string, file_path string, line_start long, line_end long, message string, suggestion string, confidence double, status string",
    "feedback": "finding_id string, feedback_type string, rule_id string, severity string, category string, reason string, comment string, stored_at timestamp_ntz",
}
#: What rows of a table are known by when they are updated.
KEYS = {"projects": ["project_id"], "reviews": ["review_id"], "findings": ["finding_id"], "feedback": ["finding_id", "stored_at"]}


class Store:
    """Tables under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; columns are taken by name and missing ones are null."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).write.mode("append").parquet(self.path(table))

    def changes(self, table: str) -> ChangingTable:
        """Updates of a table's rows by their key; of projects, the rows themselves."""
        return ChangingTable(self.spark, f"{self.path(table)}_changes", SCHEMAS[table], KEYS[table])

    def update(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        """Put new values, by key and column, in rows that were appended; keys that were not stay unknown."""
        self.changes(table).put(rows, batch=batch)

    def read(self, table: str) -> DataFrame:
        """Rows with their updates. Only keys that were updated are joined, so a table that never was costs a scan."""
        changes = self.changes(table)
        if table == "projects":
            return changes.read()
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        if not changes.exists():
            return rows
        new = changes.read().select(*[F.col(c).alias(f"_new_{c}") for c in rows.columns])
        same = F.lit(True)
        for k in KEYS[table]:
            same = same & (F.col(k) == F.col(f"_new_{k}"))
        return rows.join(new, same, "left").select(*[F.col(c) if c in KEYS[table] else F.coalesce(f"_new_{c}", c).alias(c) for c in rows.columns])

    def project(self, name: str) -> int:
        """The id of a project, which is added if it is not there; its hash, so that two writers agree and leave one row."""
        new = self.spark.range(1).select(F.xxhash64(F.lit(name)).alias("project_id"), F.lit(name).alias("name"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
        return self.changes("projects").get_or_create(new).first()["project_id"]

    def export_feedback(self, path: str) -> None:
        """All feedback, latest first, as JSON lines in part files whose names sort as their rows do."""
        self.read("feedback").orderBy(F.desc("stored_at"), "finding_id").write.mode("overwrite").json(path)

    def recent_reviews(self, n: int = 50) -> DataFrame:
        return self.read("reviews").orderBy(F.desc("started_at"), F.desc("review_id")).limit(n)

    def review_findings(self, review_id: int) -> DataFrame:
        """By severity, as text, and file."""
        return self.read("findings").where(F.col("review_id") == review_id).orderBy("severity", "file_path")
