"""Session helpers: building a session, spreading work, cutting lineage."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomcode", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster, pass the cluster's own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.shuffle.partitions": str(os.cpu_count() if cpus == "*" else cpus),
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Evens rows out before a CPU-heavy stage if the input has too few splits to keep the cores busy.

    A split may hold no row (one row group of a file lies in one split), so only a clear surplus of splits counts as enough.
    A large input has that and passes through without a shuffle. Meant for what comes straight from a scan: counting the
    partitions of a plan with shuffles would run them.
    """
    cores = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(cores * per_core)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session without one gets a folder of its own: on a cluster every
    machine would see another, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomcode-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """As :func:`cut` for a large table that is read several times: compressed columns in the same folder, where a checkpoint
    holds rows as they lie in memory."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
