"""Answers of a language model, parsed to findings. The model itself is a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<type:string,severity:string,category:string,line_start:int,line_end:int,message:string,suggestion:string,confidence:double>>"


def parse_findings(answers: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Findings of answers in JSON, fenced or bare; an answer that does not parse gives none; confidence defaults to 1."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    f = answers.select(*keys, F.explode(F.from_json(bare, FINDING)).alias("f")).select(*keys, "f.*")
    return f.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def ask(chunks: DataFrame, answer: Callable[[str], str], keys: list[str]) -> DataFrame:
    """``keys`` and ``answer`` for each chunk, a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(answer=[answer(x) for x in b["content"]])

    schema = ", ".join([*(f"`{chunks.schema[k].name}` {chunks.schema[k].dataType.simpleString()}" for k in keys), "answer string"])
    return chunks.mapInPandas(run, schema)
