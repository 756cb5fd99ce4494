"""Saving and loading vector indexes, embedding caches and states as Parquet with a one-row metadata table beside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "id string, embedding array<float>, norm double"


def save_index(vectors: DataFrame, folder: str, provider: str, model: str, id_col: str = "id", embedding: str = "embedding") -> None:
    """Writes ``id, embedding, norm`` and the other columns, and ``provider, model, dimension, n_vectors`` beside them.

    The vectors go to a folder of their own before the metadata that names it, so a reader never meets half an index: it
    sees the old one until the new one is whole.
    """
    import uuid

    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rest = [c for c in vectors.columns if c not in (id_col, embedding, "norm")]
    data = f"data-{uuid.uuid4().hex}"
    vectors.select(F.col(id_col).alias("id"), F.col(embedding).alias("embedding"), norm.alias("norm"), *rest).write.parquet(f"{folder}/{data}")
    written = vectors.sparkSession.read.parquet(f"{folder}/{data}")
    meta = written.agg(F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("n_vectors"))
    meta.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), "dimension", "n_vectors", F.current_timestamp().alias("created_at"), F.lit(data).alias("data")).coalesce(1).write.mode("append").parquet(f"{folder}/metadata")


def load_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata row of the last saved index; no row where none is."""
    try:
        found = spark.read.parquet(f"{folder}/metadata")
    except AnalysisException:
        return spark.createDataFrame([], "provider string, model string, dimension int, n_vectors bigint, created_at timestamp, data string")
    return found.orderBy(F.desc("created_at"), F.desc("data")).limit(1)


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of the last saved index; an empty table where none is."""
    last = load_metadata(spark, folder).first()
    return spark.read.parquet(f"{folder}/{last['data']}") if last else spark.createDataFrame([], VECTORS)


def compatible(provider: str = "", model: str = "", dimension: int | None = None) -> Column:
    """Whether a metadata row fits; what is not asked for, or unknown in the row, fits."""
    fits = F.lit(True)
    for name, value in (("provider", provider), ("model", model)):
        if value:
            fits = fits & (F.coalesce(name, F.lit("")).isin("", value))
    if dimension is not None:
        fits = fits & (F.coalesce("dimension", F.lit(dimension)) == dimension)
    return fits
