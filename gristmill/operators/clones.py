"""Clone detection: runs of equal normalised lines in two places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def code_lines(files: DataFrame) -> DataFrame:
    """``file_path, line_no, hash`` of lines that count: not blank, not a comment.

    Inner white space is collapsed and string literals are emptied before hashing.
    """
    lines = files.select("file_path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("pos", "line"))
    s = F.trim(F.regexp_replace("line", r"^[\s]+|[\s]+$", ""))
    lines = lines.select("file_path", (F.col("pos") + 1).alias("line_no"), s.alias("s")).where("s <> '' AND NOT startswith(s, '#')")
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"\s+", " "), '"[^"]*"', '""'), "'[^']*'", "''")
    return lines.select("file_path", "line_no", F.md5(n).alias("hash"))


def clone_runs(lines: DataFrame, min_lines: int = 6) -> DataFrame:
    """Maximal runs: file1, file2, start1, start2, length.

    Windows of ``min_lines`` consecutive lines are joined on their joint hash, so that lines which are
    frequent on their own (a brace) join nothing; windows on the same diagonal that follow each other
    are one run (gaps and islands).
    """
    w = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(0, min_lines - 1)
    windows = lines.select("file_path", "line_no", F.collect_list("hash").over(w).alias("hs"), F.max("line_no").over(w).alias("last"))
    windows = windows.where((F.size("hs") == min_lines) & (F.col("last") - F.col("line_no") == min_lines - 1)).select("file_path", "line_no", F.md5(F.concat_ws("", "hs")).alias("h"))
    a, b = windows.toDF("file1", "l1", "h"), windows.toDF("file2", "l2", "h")
    pairs = a.join(b, "h").where("file1 < file2 OR (file1 = file2 AND l2 > l1)").select("file1", "file2", "l1", (F.col("l2") - F.col("l1")).alias("d"))
    v = Window.partitionBy("file1", "file2", "d").orderBy("l1")
    runs = pairs.withColumn("island", F.col("l1") - F.row_number().over(v))
    runs = runs.groupBy("file1", "file2", "d", "island").agg(F.min("l1").alias("start1"), (F.max("l1") - F.min("l1") + min_lines).cast("long").alias("length"))
    runs = runs.where((F.col("file1") != F.col("file2")) | (F.abs("d") >= min_lines))
    return runs.select("file1", "file2", "start1", (F.col("start1") + F.col("d")).alias("start2"), "length")


def clone_blocks(lines: DataFrame, min_lines: int = 6) -> DataFrame:
    """Every start inside a maximal run that still has ``min_lines`` before it ends: the length from there."""
    runs = clone_runs(lines, min_lines)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - min_lines)).alias("k")
    blocks = runs.select("file1", "file2", "start1", "start2", "length", k)
    return blocks.select("file1", (F.col("start1") + F.col("k")).alias("start1"), "file2", (F.col("start2") + F.col("k")).alias("start2"), (F.col("length") - F.col("k")).alias("length"))


def report(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files, lines, duplicated lines and their share in per cent; blocks overlap, so it may exceed 100."""
    total = files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))
    dup = blocks.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("duplicated_lines"), F.count("*").alias("blocks"))
    return total.join(F.broadcast(dup)).withColumn("percentage", F.when(F.col("lines") > 0, F.round(F.col("duplicated_lines") / F.col("lines") * 100, 2)).otherwise(0.0))
