"""Variants of reference images: all images, all 525 variants; values as the SQL's."""

import duckdb
from pyspark.sql import functions as F

from gridlake.operators import blocks as B
from gridlake.operators import pixels as P
from gridlake.plans import image_queries as Q
from gridlake.plans.common import XYV, doubles, frame, oracle
from gridlake.sources import images as I


def test_every_image_has_every_variant(spark, sf_dir):
    df = Q.Q["q011_reference_images"].run(spark, sf_dir)
    images = I.vector_images(spark, sf_dir).count()
    n = df.groupBy("image_id").agg(F.countDistinct("tid").alias("t"), F.count("*").alias("n"), F.max("tid").alias("last")).collect()
    assert len(n) == images and all((r.t, r.n, r.last) == (525, 525 * 64, 524) for r in n)


def test_variants_equal_the_warp_in_sql(spark, sf_dir):
    px = frame(spark, sf_dir, "px").where("image_id in (0, 499)")
    got = Q.Q["q011_reference_images"].run(spark, sf_dir).where("image_id in (0, 499)")
    # x shifts count first, then y shifts, then turns
    for tx, ty, k in ((-2, -2, -10), (-2, 1, 3), (0, 0, 0), (2, -1, 7), (2, 2, 10)):
        tid = (tx + 2) * 105 + (ty + 2) * 21 + k + 10
        want = P.run(doubles(P.warp_affine(P.euclidean(float(tx), float(ty), k * 0.1), 8, 8, 255.0)), f=px)
        pixels = lambda df: {(r.image_id, r.y, r.x): r.v for r in df.collect()}
        a, b = pixels(got.where(f"tid = {tid}")), pixels(want)
        assert a.keys() == b.keys() and len(a) == 128
        assert all(abs(a[p] - float(b[p])) <= 1e-4 for p in a), tid


def test_other_steps_in_the_second_engine(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    grid = [(j, i, r) for j in (-1, 0, 1) for i in (-1, 0, 1) for r in (-1, 0, 1)]
    text = " union all ".join(f"select {k} as tid, w{k}.* from ({P.warp_affine(P.euclidean(1.0 * j, 1.0 * i, r * 0.5), 8, 8, 255.0)}) w{k}" for k, (j, i, r) in enumerate(grid))
    rel = con.execute(oracle(text, ["tid", *XYV], f="select * from {px} where image_id < 20"))
    want = {tuple(r[:4]): r[4] for r in rel.fetchall()}
    few = I.vector_images(spark, sf_dir).where("image_id < 20")
    got = {(r.tid, r.image_id, r.y, r.x): r.v for r in Q.reference_variants(few, 1, 1, 1.0, 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-4 for k in want)


def test_rows_are_made_and_rounded_in_stacks_by_many_tasks(spark, sf_dir):
    df = Q.Q["q011_reference_images"].run(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "Generate" not in plan and df.rdd.getNumPartitions() == B.SPREAD


def test_odd_blocks_and_whole_ids(spark, monkeypatch):
    """Extents apart, blocks without data left out, ids beyond 2^53 or null kept, halves away from zero."""
    monkeypatch.setattr(B, "STACK", 8)
    big = 2**53 + 1
    rows = [(big, 2, 3, [1.0, -2.0, 3.0, 4.0, 5.0, 6.0]), (None, 1, 2, [0.03125, -0.03125]), (3, 2, 2, None), (4, 2, 2, [1.0]), (big + 2, 2, 3, [0.0] * 6)]
    df = spark.createDataFrame(rows, "image_id long, rows int, cols int, data array<double>")
    got = {(r.tid, r.image_id, r.y, r.x): r.v for r in B.variants(df, lambda a, g: a * g[0], [(1.0,), (-2.0,)], places=4).collect()}
    want = {(t, i, k // c, k % c): v * g + 0.0 for t, g in enumerate((1.0, -2.0)) for i, r, c, data in rows if data and len(data) == r * c for k, v in enumerate(data)}
    want |= {(0, None, 0, 0): 0.0313, (0, None, 0, 1): -0.0313}
    want |= {(1, None, 0, 0): -0.0625, (1, None, 0, 1): 0.0625}
    assert got == want
