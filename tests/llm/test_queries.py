"""The queries of the subpackage against their SQL on the small tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from loomcode.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "p2_shards", "p4_found", "p4_terms", "p6_found"])
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)


def test_names():
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {f"p{n}_found" for n in range(1, 9)} <= set(queries.QUERIES)
