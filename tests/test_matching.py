"""Histogram matching: odd rows as its SQL has them, and no rows but the pixels on the way."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gridlake.operators import matching as H
from gridlake.operators import pixels as P
from gridlake.plans import image_queries as Q
from gridlake.plans.common import doubles


def test_odd_rows_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    odd = [(1, [0.1] * 64), (2, [None] * 32 + [0.3] * 32), (3, [0.5] * 30 + [1.5] * 34), (None, [0.1] * 64), (5, [-3.0] * 64), (6, [0.1] * 64), (6, [0.5] * 64), (7, [2.0] * 64)]
    rows = odd + [(10 + i, v) for i, v in enumerate(rng.normal(0, 0.3, (50, 64)).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(Q.Q["q054_match_hist"].sql).fetchall())
    assert sorted(map(tuple, Q.Q["q054_match_hist"].run(spark, str(tmp_path)).collect())) == want and len(want) == 57 * 64


def test_other_images_and_targets_equal_the_sql(spark):
    rng = np.random.default_rng(6)
    images = [(i, r, c, np.round(rng.uniform(-20, 280, r * c), 3).tolist()) for i, (r, c) in enumerate([(3, 5), (1, 1), (40, 70), (8, 8)])]
    df = spark.createDataFrame(images, "image_id long, rows int, cols int, data array<double>")
    target = spark.range(256).select(F.col("id").cast("int").alias("bin"), (F.col("id") * 37 % 5).alias("cnt"))
    px = [(i, k // c, k % c, v) for i, _, c, data in images for k, v in enumerate(data)]
    want = P.run(doubles(P.match_histogram()), f=spark.createDataFrame(px, "image_id long, y int, x int, v double"), t=target)
    got = H.match_histogram(df, target)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_join_of_levels(spark, sf_dir):
    plan = Q.Q["q054_match_hist"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
