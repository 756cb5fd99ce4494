from __future__ import annotations

import random

import numpy as np
import pytest

from loomcode.operators import text_search as ts
from loomcode.operators import vectors as v


def test_lines_and_matches(spark, rows):
    df = spark.createDataFrame([(1, "Alpha\r\nbeta alpha\n"), (2, ""), (3, None), (4, "none")], "k int, text string")
    table = ts.lines(df, "k", "text")
    assert table.where("k = 1").count() == 3 and table.where("k = 2").count() == 1 and table.where("k = 3").count() == 0
    assert rows(ts.grep(table, "alpha").select("k", "line_no", "col", "matched")) == [(1, 1, 0, "Alpha"), (1, 2, 5, "alpha")]
    assert rows(ts.grep(table, "alpha", case_sensitive=True).select("line_no")) == [(2,)]
    with pytest.raises(ValueError):
        ts.grep(table, "")


def test_context_limit_counts(spark, rows):
    df = spark.createDataFrame([("a", "1\n2\nx\n4\n5\n6"), ("b", "x\nx")], "k string, text string")
    table = ts.lines(df, "k", "text")
    assert rows(ts.grep_context(table, "k", "x", 1).select("k", "line_no", "context")) == [("a", 3, "2\nx\n4"), ("b", 1, "x\nx"), ("b", 2, "x\nx")]
    assert rows(ts.match_counts(ts.grep(table, "x"), "k")) == [("a", 1, 3), ("b", 2, 1)]
    assert rows(ts.first_matches(ts.grep(table, "x"), "k", 2).select("k", "line_no")) == [("a", 3), ("b", 1)]


def test_ranges(spark, rows):
    df = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("f", 7), ("f", 7), ("f", None), ("g", 5)], "k string, n int")
    assert rows(ts.line_ranges(df, "k", "n")) == [("f", "1-3, 7"), ("g", "5")]
    assert rows(ts.line_ranges(df.where("false"), "k", "n")) == []


@pytest.fixture
def axes(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0], "x"), (2, [0.0, 1.0, 0.0], "y"), (3, [0.0, 0.0, 2.0], "z"), (4, None, "n"), (5, [1.0, 0.0], "short"), (6, [0.0, 0.0, 0.0], "zero")], "vec_id bigint, embedding array<float>, score string")


def test_top_k(spark, rows, axes):
    q = spark.createDataFrame([(9, [0.9, 0.1, 0.0])], "vec_id bigint, embedding array<float>")
    assert [r.id for r in v.top_k(axes, q, 2).orderBy("rank").collect()] == [1, 2]
    # Everything comes back when k is larger than the index; equal scores rank by id.
    assert [r.id for r in v.top_k(axes, q, 100).orderBy("rank").collect()] == [1, 2, 3, 6]
    with pytest.raises(ValueError):
        v.top_k(axes, q, 0)
    assert v.top_k(axes.where("false"), q, 3).count() == 0
    assert v.top_k(axes, q.where("false"), 3).count() == 0
    assert v.above(v.top_k(axes, q, 2), 0.5).count() == 1


def test_top_k_in_blocks(spark, monkeypatch):
    random.seed(1)
    data = [(i, [random.random() for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    whole = {tuple(r) for r in v.top_k(df, df, 5).collect()}
    monkeypatch.setattr(v, "QUERY_BYTES", 8 * 8 * 7)
    assert {tuple(r) for r in v.top_k(df, df, 5).collect()} == whole
    m = np.array([x for _, x in data], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.round(m @ m.T, 6)
    for q in range(60):
        expected = sorted(range(60), key=lambda i: (-best[q, i], i))[:5]
        assert [i for _, i in sorted((r[1], r[2]) for r in whole if r[0] == q)] == expected


def test_norms_upsert_delete(spark, rows, axes):
    assert rows(v.index_stats(axes)) == [(6, 3, 3)]
    n = axes.select("vec_id", v.normalized(axes.embedding).alias("u")).where("vec_id in (3, 6)")
    assert rows(n) == [(3, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 0.0])]
    assert axes.select(v.dot(axes.embedding, axes.embedding).alias("d")).where("d is null").count() == 1
    index = spark.createDataFrame([(1, 1), (2, 2)], "vec_id int, label int")
    changes = spark.createDataFrame([(2, 20), (2, 21), (3, 3)], "vec_id int, label int")
    assert rows(v.upsert(index, changes)) == [(1, 1), (2, 21), (3, 3)]
    assert rows(v.delete(index, changes)) == [(1, 1)]


def test_queries_of_two_widths_are_refused(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, None]), (4, None), (5, [1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="components"):
        v.top_k(index, index.where("vec_id in (1, 5)"), 2)
    assert [(r.id, r.rank) for r in v.top_k(index, index.where("vec_id = 1"), 1).collect()] == [(1, 1)]
