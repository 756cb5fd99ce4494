from __future__ import annotations

from loomcode.operators import vectors
from loomcode.sources import index_io


def test_round_trip(spark, rows, tmp_path):
    folder = str(tmp_path / "index")
    assert index_io.load_index(spark, folder).count() == 0
    assert index_io.load_metadata(spark, folder).count() == 0
    df = spark.createDataFrame([("a", [3.0, 4.0], "x"), ("b", [0.0, 0.0], "y")], "id string, embedding array<float>, path string")
    index_io.save_index(df, folder, "hash", "v1")
    index_io.save_index(vectors.upsert(df, df.where("id = 'b'").selectExpr("'c' as id", "embedding", "path"), "id"), folder, "hash", "v1")
    assert rows(index_io.load_index(spark, folder)) == [("a", [3.0, 4.0], 5.0, "x"), ("b", [0.0, 0.0], 0.0, "y"), ("c", [0.0, 0.0], 0.0, "y")]
    meta = index_io.load_metadata(spark, folder)
    assert rows(meta.select("provider", "model", "dimension", "n_vectors")) == [("hash", "v1", 2, 3)]
    assert meta.where(index_io.compatible("hash", "", 2)).count() == 1
    assert meta.where(index_io.compatible("", "v2")).count() == 0
    assert meta.where(index_io.compatible(dimension=3)).count() == 0
