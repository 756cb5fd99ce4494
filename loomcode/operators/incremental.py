"""Change detection, dirty state and batches of notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each path; at equal times a dirty one stands, then the greater hash. Null times come first."""
    order = F.struct(F.coalesce("last_seen", F.lit(-1)).alias("at"), F.coalesce("is_dirty", F.lit(False)).alias("dirty"), F.coalesce("hash", F.lit("")).alias("h"))
    return states.where("path is not null").groupBy("path").agg(F.max(order).alias("s")).select("path", F.col("s.h").alias("hash"), F.col("s.dirty").alias("is_dirty"), F.col("s.at").alias("last_seen"))


def detect_changes(files: DataFrame, states: DataFrame) -> DataFrame:
    """``path, status, is_dirty`` over the files and the known states: new, changed, unchanged or removed.

    The hash is SHA-256 of the content; an unchanged file is clean, whatever it was before.
    """
    now = files.where("path is not null").groupBy("path").agg(F.max(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("current"))
    both = now.join(latest_states(states).select("path", "hash"), "path", "full")
    status = F.when(F.col("hash").isNull(), "new").when(F.col("current").isNull(), "removed").when(F.col("hash") == F.col("current"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"), (status != "unchanged").alias("is_dirty"))


def merge_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Marks changed paths as dirty in their last state and adds unknown ones; removed paths go, others stay as they are."""
    old = latest_states(states)
    merged = old.join(changes.select("path", "status"), "path", "full").where("coalesce(status, '') <> 'removed'")
    dirty = F.when(F.col("status").isin("new", "changed"), True).when(F.col("status") == "unchanged", False).otherwise(F.coalesce("is_dirty", F.lit(False)))
    return merged.select("path", F.coalesce("hash", F.lit("")).alias("hash"), dirty.alias("is_dirty"), F.coalesce("last_seen", F.lit(-1)).alias("last_seen"))


def clear_dirty(states: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All states clean, or those of the given paths."""
    if paths is None:
        return states.withColumn("is_dirty", F.lit(False))
    marked = paths.select("path").distinct().withColumn("clear", F.lit(True))
    return states.join(marked, "path", "left").withColumn("is_dirty", F.col("is_dirty") & F.col("clear").isNull()).drop("clear")


def notification_batches(states: DataFrame, threshold: int = 20, bucket_seconds: int = 86_400) -> DataFrame:
    """``batch, n_paths, first_seen, last_seen``: dirty paths in the order of their first notice, ``threshold`` to a batch.

    The order is global, but no task sorts all: counts of time buckets give each bucket its offset, and rows are numbered
    inside their bucket only.
    """
    first = states.where("is_dirty and path is not null").groupBy("path").agg(F.min(F.coalesce("last_seen", F.lit(0))).alias("seen")).withColumn("bucket", F.floor(F.col("seen") / bucket_seconds))
    buckets = first.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row for each day: the running sum is over days, not over notices.
    offsets = buckets.withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).select("bucket", "before")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("seen", "path")) - 1 + F.col("before")
    numbered = first.join(offsets, "bucket").withColumn("batch", F.floor(place / threshold))
    return numbered.groupBy("batch").agg(F.count("*").alias("n_paths"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
