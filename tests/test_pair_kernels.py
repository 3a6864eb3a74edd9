"""The kernels of all-pairs queries against plain differences, and rounding in stacks against Spark's."""

import numpy as np
import pytest

from gridlake.functions.rounding import round_half_up
from gridlake.operators import pairs as A
from gridlake.plans import image_queries as Q

PLAIN = {
    "correlation": lambda x, y, m: ((x - m) * (y - m)).sum() / np.sqrt(((x - m) ** 2).sum() * ((y - m) ** 2).sum()) if ((x - m) ** 2).sum() * ((y - m) ** 2).sum() else 1.0,
    "chi_square": lambda x, y, m: sum((p - q) ** 2 / p for p, q in zip(x, y, strict=True) if p > 0),
    "intersect": lambda x, y, m: np.minimum(x, y).sum(),
    "chebyshev": lambda x, y, m: np.abs(x - y).sum(),
    "hellinger": lambda x, y, m: np.sqrt(max(1 - np.sqrt(x * y).sum() / np.sqrt(x.sum() * y.sum()), 0)),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
@pytest.mark.parametrize("top", (3, 200, 5_000, 1e6, 1e11, 0.5))
def test_histograms(name, top):
    rng = np.random.default_rng(int(top))
    a, b = (rng.uniform(0, top, (n, 32)) * rng.integers(0, 2, (n, 32)) for n in (9, 14))
    a, b = (a, b) if top < 1 else (np.floor(a), np.floor(b))
    b[:3] = a[:3]
    want = [[PLAIN[name](x, y, top / 4) for y in b] for x in a]
    assert np.allclose(A.HISTOGRAMS[name](a, b, top / 4), want, rtol=1e-9, atol=1e-6 if name == "hellinger" else 1e-9)


def test_distances_keep_their_digits():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 16))
    for scale, far, gap in ((1, 0, 1e-3), (1, 1e6, 1e-3), (1e-120, 0, 1e-3), (1e160, 0, 1e-3)):
        x, y = scale * (a + far), scale * (a + far + gap * rng.normal(size=a.shape))
        with np.errstate(over="ignore"):
            want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        assert np.allclose(A.distance(x, y), want, rtol=1e-9)
    assert (np.diag(A.distance(a, a)) == 0).all()
    a[0, 0] = np.nan
    assert np.isnan(A.distance(a, a)[0]).all() and np.isfinite(A.distance(a, a)[1:, 1:]).all()


def test_over_counts_as_rounded_differences_do():
    rng = np.random.default_rng(2)
    steps = np.round(rng.integers(-9, 9, (70, 12)) * 0.1, 1)  # many differences of 0.1, rounded up or down
    for a, b in ((steps, steps[::-1]), (rng.normal(size=(60, 9)), rng.normal(size=(50, 9))), (steps * 1e9, steps * 1e9 + 0.1), (steps[:, :3], np.where(steps[:, :3] > 0.8, np.nan, steps[:, :3]))):
        assert (A.over(0.1)(a, b) == (np.abs(a[:, None] - b[None]) > 0.1).sum(-1)).all()


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-9_000, 9_000, 3_000) / 32 / 64, rng.integers(-10**7, 10**7, 3_000) / 1e5, rng.normal(0, 10.0 ** rng.integers(-6, 14, 3_000)), [0.0, -0.0, -1e-9, 0.00005, 1e300, -1e18, 4.5e11]])
    v = np.concatenate([v, np.nextafter(v, 1e301), np.nextafter(v, -1e301)])
    df = spark.createDataFrame([(x,) for x in v.tolist()], "v double").selectExpr("round(v, 4) + 0.0D as v")
    want = np.array([r.v for r in df.collect()])
    got = round_half_up(v)
    assert (got == want).all() and not np.signbit(got[want == 0]).any()


def test_rows_are_not_rounded_one_by_one(spark, sf_dir):
    for name in ("q057_compare_hist_chebyshev", "q114_batch_diff", "q116_batch_diff_over"):
        assert "round(" not in Q.Q[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
