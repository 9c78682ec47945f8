"""The silhouette queries measure every row, not a sample."""

import duckdb
import numpy as np

from gaugeflow import catalog
from gaugeflow.operators import evaluation


def test_more_rows_than_a_sample_against_the_sql(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.standard_normal(64) + (i % 3) * 0.4], None if i == 2100 else i % 3 if i else 9) for i in range(2200)]
    rows += [(2200 + i, rows[5][1], 2) for i in range(3)]  # equal vectors
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("silhouette_raw", "silhouette_features"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).first()
        value, n = con.execute(catalog.ORACLES[name]).fetchone()
        assert n == got.n == 2203 and abs(got.silhouette - value) <= 1e-6


def test_tiles_do_not_change_the_value(spark):
    rng = np.random.default_rng(12)
    rows = [(i, i % 4, rng.standard_normal(6).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y int, v array<double>")
    one, many = (evaluation.silhouette(df, "id", "y", "v", tile=t).first() for t in (4096, 16))
    assert one.n == many.n == 150 and abs(one.silhouette - many.silhouette) < 1e-12


def test_points_without_a_vector_are_left_out(spark):
    rows = [(1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.5]), (3, 1, [4.0, 1.0]), (4, 1, None), (5, 1, [None, 1.0]), (6, None, [1.0, 1.0])]
    got = evaluation.silhouette(spark.createDataFrame(rows, "id long, y int, v array<double>"), "id", "y", "v").first()
    assert got.n == 4
    assert evaluation.silhouette(spark.createDataFrame([], "id long, y int, v array<double>"), "id", "y", "v").first().n == 0
