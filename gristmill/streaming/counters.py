"""Counters of findings kept up to date as findings arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import counts


def running_counters(stream: DataFrame, key: str = "review_id") -> DataFrame:
    """Totals by level of each review: a stateful aggregation for output mode ``update`` or ``complete``."""
    return stream.groupBy(key).agg(F.count("*").alias("total_findings"), *counts())


def start(counters: DataFrame, name: str, checkpoint: str | None = None):
    """Keep the counters in a table of the session, under ``name``; returns the running query."""
    w = counters.writeStream.outputMode("complete").format("memory").queryName(name)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).trigger(availableNow=True).start()
