"""Uploaded review results: nested JSON to review and finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """metadata struct<total_files:int,total_lines:int,provider:string,model:string,total_tokens:int,total_cost:double,duration_seconds:double>,
findings array<struct<type:string,severity:string,category:string,file:string,line:int,line_end:int,message:string,suggestion:string,confidence:double>>"""


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path).withColumn("upload", F.input_file_name())


def findings_of(uploads: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each finding of each upload."""
    f = uploads.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")
    return f.withColumnsRenamed({"file": "file_path", "line": "line_start"})
