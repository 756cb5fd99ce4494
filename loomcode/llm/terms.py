"""Frequency of every distinct term, heavy terms apart from light ones.

A sketch over all terms finds the heavy ones. In one pass over the rows each task then counts the heavy terms' occurrences
in an array and marks them in a bit mask for each record, and hands on the light terms only; masks and light terms are
combined by record, the masks are counted in arrays again, and both count tables are united. So a heavy term is never
shuffled, and a record that holds a third of all rows is one short row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcode.session import cut

#: A term is heavy with at least this share of its field's occurrences; at most so many are (the masks have as many bits), and
#: the sketch that finds them tracks so many terms.
HEAVY_SHARE, HEAVY, TRACKED = 0.001, 256, 4096
RARE_BELOW, COMMON_SHARE = 3, 0.12
MASKS = [f"m{k}" for k in range(HEAVY // 64)]


def field_rows(rows: DataFrame, record: str, terms: str, field: str) -> DataFrame:
    """``field, record, terms`` of one array column."""
    return rows.select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), F.col(terms).alias("terms"))


def heavy_terms(rows: DataFrame, limit: int = HEAVY, share: float = HEAVY_SHARE) -> list[tuple[str, str]]:
    """(field, term) of the terms that a frequent-items sketch over all occurrences finds heavy: at most ``limit``, whatever
    the data."""
    each = rows.select("field", F.explode("terms").alias("t")).select("field", F.trim("t").alias("term")).where("term <> ''")
    found = each.groupBy("field").agg(F.expr(f"approx_top_k(term, {limit}, {max(TRACKED, limit)})").alias("top"), F.count("*").alias("n")).collect()
    ranked = sorted(((x["count"] / r["n"], r["field"], x["item"]) for r in found for x in r["top"] or [] if x["count"] > max(1, share * r["n"])), reverse=True)
    return sorted((field, term) for _, field, term in ranked[:limit])


def term_counts(rows: DataFrame, limit: int = HEAVY, share: float = HEAVY_SHARE) -> DataFrame:
    """``field, term, n_occurrences, n_records`` exactly, for every term of ``field, record, terms``; and for each field a row
    with a null term that has the number of its distinct records.

    A term is an array element without the spaces around it; null and empty elements are none. A record has a term if any of
    its rows has it; rows without a record id count as occurrences only. Which terms count as heavy changes the work and
    never the result.
    """
    heavy = heavy_terms(rows, limit, share)
    slots = {t: k for k, t in enumerate(heavy)}
    bits = 64 * len(MASKS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences = np.zeros(bits, np.int64)
        for batch in batches:
            fields, records, lists = (batch.column(k) for k in range(3))
            parents = pc.list_parent_indices(lists)
            terms = pc.utf8_trim(pc.list_flatten(lists), " ")
            told = pc.fill_null(pc.not_equal(terms, ""), False)
            parents, terms = parents.filter(told).to_numpy(zero_copy_only=False), terms.filter(told)
            # The rows of a batch are of few fields and the terms repeat, so slots are looked up by distinct value.
            coded, coded_fields = terms.dictionary_encode(), fields.dictionary_encode()
            known = np.array([[slots.get((f, t), -1) for t in coded.dictionary.to_pylist()] for f in coded_fields.dictionary.to_pylist()], np.int64).reshape(len(coded_fields.dictionary), len(coded.dictionary))
            at = known[coded_fields.indices.to_numpy(zero_copy_only=False)[parents], coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
            heavies, lights = at >= 0, pa.array(at < 0)
            occurrences += np.bincount(at[heavies], minlength=bits)
            present = np.zeros((len(fields), bits), np.bool_)
            present[parents[heavies], at[heavies]] = True
            masks = np.packbits(present, axis=1, bitorder="little").view(np.int64)
            own = pa.array(parents).filter(lights)
            yield _batch(fields.take(own), records.take(own), terms.filter(lights), np.ones(len(own), np.int64), np.zeros((len(own), len(MASKS)), np.int64))
            held = records.is_valid()
            yield _batch(fields.filter(held), records.filter(held), pa.nulls(pc.sum(held).as_py() or 0, pa.string()), np.zeros(pc.sum(held).as_py() or 0, np.int64), masks[held.to_numpy(zero_copy_only=False)])
        used = [k for k in range(len(heavy)) if occurrences[k]]
        yield _batch(pa.array([heavy[k][0] for k in used], pa.string()), pa.nulls(len(used), pa.string()), pa.array([heavy[k][1] for k in used], pa.string()), occurrences[used], np.zeros((len(used), len(MASKS)), np.int64))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, totals = np.zeros(bits, np.int64), {}
        for batch in batches:
            fields, terms = batch.column(0), batch.column(2)
            plain = terms.is_valid()
            some = batch.column(1).is_valid().filter(plain).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([fields.filter(plain), terms.filter(plain), batch.column(3).filter(plain), some], names=["field", "term", "n_occurrences", "n_records"])
            held = pc.invert(plain)
            masks = np.column_stack([batch.column(4 + k).filter(held).to_numpy(zero_copy_only=False) for k in range(len(MASKS))]).astype(np.int64)
            records += np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            for f in pc.value_counts(fields.filter(held)).to_pylist():
                totals[f["values"]] = totals.get(f["values"], 0) + f["counts"]
        used = [k for k in range(len(heavy)) if records[k]]
        named = [*((*heavy[k], int(records[k])) for k in used), *((f, None, n) for f, n in totals.items())]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in named], pa.string()), pa.array([x[1] for x in named], pa.string()), pa.array([0] * len(named), pa.int64()), pa.array([x[2] for x in named], pa.int64())], names=["field", "term", "n_occurrences", "n_records"])

    columns = ", ".join(f"{m} bigint" for m in MASKS)
    pairs = rows.select("field", "record", "terms").mapInArrow(split, f"field string, record string, term string, n bigint, {columns}")
    # One term of one record is one row whatever the number of rows: they are combined before the shuffle.
    combined = pairs.groupBy("field", "record", "term").agg(F.sum("n").alias("n"), *[F.bit_or(m).alias(m) for m in MASKS])
    counted = combined.mapInArrow(fold, "field string, term string, n_occurrences bigint, n_records bigint")
    return counted.groupBy("field", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def _batch(fields: pa.Array, records: pa.Array, terms: pa.Array, n: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    arrays = [fields, records, terms, pa.array(n), *(pa.array(np.ascontiguousarray(masks[:, k])) for k in range(len(MASKS)))]
    return pa.RecordBatch.from_arrays([a.cast(pa.string()) if k < 3 else a for k, a in enumerate(arrays)], names=["field", "record", "term", "n", *MASKS])


def marked_terms(rows: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE, limit: int = HEAVY) -> DataFrame:
    """``field, term, n_occurrences, n_records, mark`` of ``field, record, terms``.

    The mark is ``rare`` below ``rare_below`` records, else ``common`` above ``common_share`` of all distinct records (rows
    with null arrays included), else null. Repeated rows of a record count once as a record and each time as occurrences.
    """
    counts = cut(term_counts(rows, limit))
    # One number a field: the fields are those that the caller names.
    totals = {r.field: r.n_records for r in counts.where("term is null").collect()}
    total = F.lit(0)
    for field, n in totals.items():
        total = F.when(F.col("field") == field, F.lit(n)).otherwise(total)
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_share * total, "common")
    return counts.where("term is not null").select("field", "term", "n_occurrences", "n_records", mark.alias("mark"))


def project_terms(units: DataFrame, modules: DataFrame) -> DataFrame:
    """The dependencies of code units and the imports of modules."""
    return marked_terms(field_rows(units, "unit_id", "dependencies", "dependencies").unionByName(field_rows(modules, "file", "imports", "imports")))
