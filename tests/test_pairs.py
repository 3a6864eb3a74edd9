"""All-pairs queries over whole tables, against brute force and, where it reaches, their SQL."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from gridlake.plans import registry

Q = registry.all_queries()
NAMES = ["q114_batch_diff", "q116_batch_diff_over", *(f"q057_compare_hist_{k}" for k in ("correlation", "chi_square", "intersect", "chebyshev", "hellinger"))]


def brute(name, vectors):
    if name == "q114_batch_diff":
        return lambda i, j: np.sqrt(((vectors[i] - vectors[j]) ** 2).sum())
    if name == "q116_batch_diff_over":
        return lambda i, j: (np.abs(vectors[i] - vectors[j]) > 0.1).sum()
    h = [np.bincount((np.floor((v + 0.6) * 200) // 8).astype(int), minlength=32).astype(float) for v in vectors]
    m = h[0].mean()
    return {
        "correlation": lambda i, j: ((h[i] - m) * (h[j] - m)).sum() / np.sqrt(((h[i] - m) ** 2).sum() * ((h[j] - m) ** 2).sum()),
        "chi_square": lambda i, j: sum((x - y) ** 2 / x for x, y in zip(h[i], h[j], strict=True) if x > 0),
        "intersect": lambda i, j: np.minimum(h[i], h[j]).sum(),
        "chebyshev": lambda i, j: np.abs(h[i] - h[j]).sum(),
        "hellinger": lambda i, j: np.sqrt(max(1 - np.sqrt(h[i] * h[j]).sum() / np.sqrt(h[i].sum() * h[j].sum()), 0)),
    }[name.removeprefix("q057_compare_hist_")]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, sf_dir, name):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").sort_by("vec_id")
    vectors = np.array(t["embedding"].to_pylist(), float)
    got = {(r.a_id, r.b_id): r.v for r in Q[name].run(spark, sf_dir).collect()}
    n = len(vectors)
    assert len(got) == n * n
    want, rng = brute(name, vectors), np.random.default_rng(7)
    for i, j in [(n - 1, n - 1), (n - 1, 0), *rng.integers(0, n, (2_000, 2)).tolist()]:
        assert abs(got[i, j] - want(i, j)) <= 1e-4, (i, j)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    rows = con.execute(Q[name].sql).fetchall()
    assert rows and all(abs(got[a, b] - v) <= 1.01e-4 for a, b, v in rows)
