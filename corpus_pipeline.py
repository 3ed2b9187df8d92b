"""A corpus from raw documents to packed sequences, in five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import langid, line_quality, minhash_forest, mix_sources, packing
from gristmill.llm.common import drop_stored, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that their host repeats."""
    return line_quality.quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or where no language leads, go."""
    return langid.language_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return minhash_forest.drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_sources.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of several lengths."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("language id", language), ("near-dedup", near_dedup), ("mix to weights", mix), ("best-fit packing", pack)]

#: Language identification and packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written to the shared folder, which is deleted then; the last one's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = store(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            drop_stored(docs)  # the stage before is read no more
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
