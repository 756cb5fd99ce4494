"""The driver's contract, and SQL against Spark on the small tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomcode.plans import catalogue

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
COMPARED = ["vec_topk_cosine", "text_grep_context", "ignored_files", "path_tree", "call_resolution", "impact_transitive", "cfg_complexity", "pdg_edges", "slice_backward", "dirty_diff", "notify_batches", "source_imports", "function_signatures", "unit_embedding_text"]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"vec_topk_cosine", "call_resolution"} <= set(catalogue.QUERIES)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    found = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)

    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v

    ours = sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert ours == theirs
