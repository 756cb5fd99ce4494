from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from loomcode.operators import cache, incremental
from loomcode.streaming import notify

STATE = "path string, hash string, is_dirty boolean, last_seen bigint"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_changes(spark, rows):
    files = spark.createDataFrame([("same", "1"), ("same", "1"), ("edited", "2"), ("added", "3"), (None, "x")], "path string, content string")
    states = spark.createDataFrame([("same", _sha("1"), True, 5), ("edited", _sha("old"), False, 5), ("gone", "h", False, 1), ("edited", _sha("2"), False, 1), (None, "h", True, 1)], STATE)
    found = incremental.detect_changes(files, states)
    assert rows(found) == [("added", "new", True), ("edited", "changed", True), ("gone", "removed", True), ("same", "unchanged", False)]
    assert rows(incremental.merge_states(states, found).select("path", "is_dirty")) == [("added", True), ("edited", True), ("same", False)]
    latest = incremental.latest_states(states)
    assert latest.where("is_dirty").count() == 1
    assert incremental.clear_dirty(latest, spark.createDataFrame([("same",)], "path string")).where("is_dirty").count() == 0
    assert incremental.clear_dirty(latest).where("is_dirty").count() == 0
    assert incremental.detect_changes(files.where("false"), states.where("false")).count() == 0


def test_batches(spark, rows):
    data = [(f"p{i:03}", "h", True, 40_000 * (i % 7) + i) for i in range(50)] + [("p001", "h", True, 10**9), ("clean", "h", False, 1)]
    found = rows(incremental.notification_batches(spark.createDataFrame(data, STATE)))
    order = sorted((40_000 * (i % 7) + i, f"p{i:03}") for i in range(50))
    assert found == [(k, len(order[20 * k : 20 * k + 20]), order[20 * k][0], order[20 * k : 20 * k + 20][-1][0]) for k in range(3)]


def test_cache(spark, rows):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    known = spark.createDataFrame([(_sha("a"),), (_sha("a"),)], "key string")
    assert rows(cache.probe(texts, known).select("text", "hit")) == [("a", True), ("b", False), ("b", False), (None, False)]
    assert sorted(r.key for r in cache.misses(texts, known).collect()) == sorted([_sha("b"), _sha("")])
    assert cache.probe(texts.where("false"), known).agg(cache.hit_rate(F.col("hit"))).first()[0] == 0.0


def test_streams(spark, rows, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", True, 100), ("a", "1", True, 100), ("b", "1", False, 90_000)], STATE).coalesce(1).write.parquet(folder)
    stream = notify.first_notices(notify.read_notices(spark, folder)).select("path", "hash")
    assert rows(notify.stream_to_table(spark, stream, "first")) == [("a", "1")]
    daily = notify.stream_to_table(spark, notify.daily_counts(notify.read_notices(spark, folder)), "daily", "complete")
    assert rows(daily.select("n_notices", "n_dirty")) == [(1, 0), (2, 2)]


def test_threshold(spark, tmp_path):
    folder, called = str(tmp_path / "in"), []
    act = notify.Threshold(str(tmp_path / "work"), lambda df: called.append(sorted(r.path for r in df.collect())), threshold=3)
    for part in (["a", "b", "a"], ["b"], ["c"], ["d"]):
        spark.createDataFrame([(p, "h", True, 1) for p in part], STATE).coalesce(1).write.mode("append").parquet(folder)
        notify.run_once(notify.read_notices(spark, folder).where("is_dirty"), act, str(tmp_path / "state"))
    assert called == [["a", "b", "c"]]
