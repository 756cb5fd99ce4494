"""Vector index operations on a table of ``id, embedding``: norms, similarity, exact top-k, upsert, delete."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Bytes of query vectors that go to every task at once; more queries are answered in blocks of this size.
QUERY_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a vector is null, 0 if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length or the lengths differ."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), F.lit(0.0)).otherwise(dot(a, b) / lengths)


def index_stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``n_vectors, dimension, n_unit`` of an index; vectors within 1e-3 of length 1 count as unit."""
    size = F.when(F.col(embedding).isNotNull(), F.size(embedding))
    return vectors.agg(F.count("*").alias("n_vectors"), F.max(size).alias("dimension"), F.count_if(F.abs(norm(F.col(embedding)) - 1) < 1e-3).alias("n_unit"))


def _unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the width and no null, and those at length 1, from the array's own buffer."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    keep = lengths == width
    chosen = vectors.filter(pa.array(keep))
    flat = chosen.flatten()
    if flat.null_count and width:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
        keep[np.flatnonzero(keep)[~whole]] = False
        flat = chosen.filter(pa.array(whole)).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(keep.sum()), width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return keep, np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query, by score and then id: only what reaches the k-th score is sorted."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", digits: int = 6) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest vectors by cosine for every query vector, exactly.

    Each task multiplies its batch of vectors with the block of queries and keeps its k best for each query; only these
    are shuffled. Queries beyond the size bound are answered block by block. Equal scores (after rounding) rank by id.
    Null vectors, and those of another width than the queries, take no part; vectors without a length score 0.
    Raises ValueError if k is not positive or the queries differ in width.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(embedding).alias("v")).where("query_id is not null and v is not null")
    widest = asked.agg(F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least"), F.count("*").alias("n")).first()
    width = widest["width"] or 0
    if (widest["least"] or 0) != width:
        raise ValueError(f"query vectors of {widest['least']} and of {width} components")
    block = max(1, QUERY_BYTES // (8 * max(1, width)))
    n_blocks = -(-max(1, widest["n"]) // block)
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    kinds = [to_arrow_type(vectors.schema[id_col].dataType)] * 2
    schema = f"query_id {id_type}, id {id_type}, score double"
    answers = []
    for number in range(n_blocks):
        part = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number)
        rows = part.where(~F.exists("v", lambda x: x.isNull())).collect()
        held = spark.sparkContext.broadcast(([r["query_id"] for r in rows], _unit_rows(pa.array([r["v"] for r in rows], type=pa.list_(pa.float64())), width)[1]))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            best_scores = np.full((len(names), 0), -np.inf)
            best_ids = np.empty((len(names), 0), dtype=object)
            for batch in batches:
                keep, units = _unit_rows(batch.column(1), width)
                if not len(units) or not names:
                    continue
                found = np.array(batch.column(0).filter(pa.array(keep)).to_pylist(), dtype=object)
                scores = np.concatenate([best_scores, np.round(matrix @ units.T, digits) + 0.0], axis=1)
                ids = np.concatenate([best_ids, np.broadcast_to(found, (len(names), len(found)))], axis=1)
                order = np.array([_best(s, i, k) for i, s in zip(ids, scores, strict=True)])
                best_scores, best_ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
            n = best_scores.shape[1]
            out = [x for x in names for _ in range(n)], best_ids.ravel().tolist(), best_scores.ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type=kinds[0]), pa.array(out[1], type=kinds[1]), pa.array(out[2], type=pa.float64())], names=["query_id", "id", "score"])

        answers.append(vectors.where(F.col(id_col).isNotNull()).select(id_col, embedding).mapInArrow(search, schema))
    local = answers[0]
    for other in answers[1:]:
        local = local.unionByName(other)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits with at least a score, after the top-k: fewer than k may stay."""
    return hits.where(F.col("score") >= threshold)


def upsert(index: DataFrame, changes: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The index with the changes in place of or beside its rows; of several changes of one id the greatest row stands."""
    latest = changes.groupBy(id_col).agg(F.max(F.struct(*[c for c in changes.columns if c != id_col])).alias("r")).select(id_col, "r.*")
    return index.join(latest.select(id_col), id_col, "left_anti").unionByName(latest.select(*index.columns))


def delete(index: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The index without the given ids; unknown and null ids change nothing."""
    return index.join(ids.select(id_col).distinct(), id_col, "left_anti")


def centroids(vectors: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """``by, component, mean`` for each component, in double precision."""
    return vectors.select(by, F.posexplode(embedding).alias("component", "x")).groupBy(by, "component").agg(F.avg(F.col("x").cast("double")).alias("mean"))
