"""Content-addressed cache: probing by hash and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def probe(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``key`` and ``hit``: whether the content stands in the cache (``key``, possibly repeated)."""
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    return texts.withColumn("key", content_key(F.col(text))).join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """The distinct contents that must be computed: an anti-join, one row for each key."""
    return texts.withColumn("key", content_key(F.col(text))).join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(text).alias(text))


def hit_rate(hits: Column) -> Column:
    """hits / lookups; 0 without a lookup."""
    return F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.count_if(hits) / F.count("*"))

