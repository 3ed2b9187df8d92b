"""Cutting texts into line chunks with overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_chunks(files: DataFrame, max_tokens: int = 4000, overlap: int = 10, text: str = "content", key: str = "file_path") -> DataFrame:
    """``key, chunk, start_line, end_line, content, context``: runs of lines, 4 characters to a token, 50 characters to a line.

    A text that fits is one chunk without context; the others start ``overlap`` lines before the last
    one's end, and the chunk that reaches the end is the last.
    """
    per = max(max_tokens * 4 // 50, 50)
    step = max(1, per - overlap)
    f = files.select(key, F.split(text, "\n", -1).alias("lines")).withColumn("n", F.size("lines"))
    last = F.when(F.col("n") <= per, 0).otherwise(F.ceil((F.col("n") - per) / step)).cast("int")
    c = f.select(key, "lines", "n", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    begin = F.col("chunk") * step
    end = F.least(begin + per, F.col("n"))
    context = F.when(F.col("chunk") > 0, F.array_join(F.slice("lines", F.greatest(begin - overlap, F.lit(0)) + 1, F.least(begin, F.lit(overlap))), "\n"))
    return c.select(key, "chunk", (begin + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", begin + 1, end - begin), "\n").alias("content"), context.alias("context"))


def whole_files(files: DataFrame, text: str = "content", key: str = "file_path") -> DataFrame:
    """Each text as one chunk."""
    return files.select(key, F.lit(0).alias("chunk"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n", -1)).alias("end_line"), F.col(text).alias("content"), F.lit(None).cast("string").alias("context"))


#: Chunkers by name; the last two cut like the first.
CHUNKERS = {"simple": line_chunks, "sliding_window": line_chunks, "ast_aware": line_chunks, "file_based": whole_files}
