"""Notices of changed files as a stream: first notices, and batches that trigger work at a threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcode.session import checkpoint_dir


def read_notices(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Parquet files of file states as they arrive, in a folder or as one file; their schema is that of what is there."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name a single file too.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")


def first_notices(notices: DataFrame, late: str = "30 days") -> DataFrame:
    """The first dirty notice of each path and hash; the state of older ones is dropped by the watermark."""
    timed = notices.where("is_dirty and path is not null").withColumn("seen_at", F.timestamp_seconds("last_seen"))
    return timed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["path", "hash"])


def daily_counts(notices: DataFrame, late: str = "30 days") -> DataFrame:
    """``start, n_notices, n_dirty`` of each day of event time, for complete or update output."""
    timed = notices.withColumn("seen_at", F.timestamp_seconds("last_seen")).withWatermark("seen_at", late)
    return timed.groupBy(F.window("seen_at", "1 day").alias("w")).agg(F.count("*").alias("n_notices"), F.count_if("is_dirty").alias("n_dirty")).select(F.col("w.start").alias("start"), "n_notices", "n_dirty")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Feeds all that has arrived to the sink, batch by batch, and ends; a later call goes on from there."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


class Threshold:
    """Collects distinct dirty paths in a table and hands them to an action once there are enough.

    The pending paths are a Parquet table with one folder for each batch, written before the batch is acknowledged, so a
    batch that runs again overwrites its own folder and counts once. Paths that arrive while the action runs stay pending.
    """

    def __init__(self, folder: str, action: Callable[[DataFrame], None], threshold: int = 20) -> None:
        self.folder, self.action, self.threshold = folder, action, threshold
        self.done: set[int] = set()

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.select("path").distinct().write.mode("overwrite").parquet(f"{self.folder}/pending/batch={number}")
        spark = batch.sparkSession
        pending = spark.read.parquet(f"{self.folder}/pending").where(~F.col("batch").isin(sorted(self.done) or [-1]))
        paths = pending.select("path").distinct()
        if paths.count() >= self.threshold:
            self.action(paths)
            self.done.update(range(number + 1))


def stream_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what has arrived and reads its result back from the shared folder."""
    import uuid

    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", f"{root}/table").start().awaitTermination()
    else:
        # The whole result of each batch replaces the one before it.
        run_once(stream, lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/table"), f"{root}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
