"""Content-addressed cache of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(content_hash: Column, types: Sequence[str], provider: str, model: str) -> Column:
    """sha256 over the content's hash, the sorted review types, provider and model."""
    return F.sha2(F.concat_ws(":", F.coalesce(content_hash, F.lit("")), F.lit(",".join(sorted(types))), F.lit(provider), F.lit(model)), 256)


def split_by_cache(files: DataFrame, cached: DataFrame, keys: list[str], ttl_seconds: int | None = None, now: Column | None = None, same: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that the cache holds, and those that it lacks or whose entry is older than ``ttl_seconds``.

    ``same`` names further columns that must be equal, of files and of the cache.
    """
    live = cached if ttl_seconds is None else cached.where(F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.col("stored_at") <= ttl_seconds)
    on = None
    for k in keys:
        on = files[k] == live[k] if on is None else on & (files[k] == live[k])
    for a, b in (same or {}).items():
        on = on & files[a].eqNullSafe(live[b])
    return files.join(live, on, "left_semi"), files.join(live, on, "left_anti")


def cache_stats(lookups: DataFrame) -> DataFrame:
    """Hits, misses and the share of hits."""
    s = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return s.withColumn("hit_rate", F.when(total > 0, F.col("hits") / total).otherwise(0.0))
