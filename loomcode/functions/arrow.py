"""Arrow-batched row functions: the small Python helpers that Spark runs inside its tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that map_runs gives back.
ROWS = 10_000


def map_lists(df: DataFrame, fn: Callable[..., list], schema: str) -> DataFrame:
    """Applies ``fn`` to each Arrow batch: one Python list for each column in, a list of output tuples out."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = fn(*(c.to_pylist() for c in batch.columns))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_runs(df: DataFrame, key: str, fn: Callable[..., Iterator[tuple]], schema: str, met: bool = False) -> DataFrame:
    """Applies ``fn`` to the rows of each key: the key and one Python list for each other column in, tuples out one by one.

    The first column is the key. A task holds the rows of one key and two batches, however many keys it has. ``met``: the
    rows of a key lie in one partition, by the exchange of ``df`` itself; not to be said of a union, whose sides may be
    coalesced apart.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list]]]:
        now, held = None, []
        for batch in batches:
            keys, *columns = (c.to_pylist() for c in batch.columns)
            start = 0
            for name, same in groupby(keys):
                end = start + sum(1 for _ in same)
                if held and name == now:
                    for old, c in zip(held, columns, strict=True):
                        old += c[start:end]
                else:
                    if held:
                        yield now, held
                    now, held = name, [c[start:end] for c in columns]
                start = end
        if held:
            yield now, held

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for name, columns in runs(batches):
            for row in fn(name, *columns):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    # By a hash of the key: an exchange by the key itself is dropped over a union of two sides that are partitioned by it.
    return (df if met else df.repartition(F.xxhash64(key))).sortWithinPartitions(key).mapInArrow(run, schema)
