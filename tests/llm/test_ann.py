"""Nearest vectors: recall against brute force, exact scores and order, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from gridlake.llm import ann
from gridlake.llm.queries import QUERIES


def brute(rows, ask, k):
    """query_id to [(vec_id, score)] of all other rows."""
    good = {i: np.asarray(v, np.float64) for i, v in rows}
    ids = np.asarray(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ask:
        s = x @ good[q]
        order = np.lexsort((ids, -s))
        out[q] = [(int(ids[i]), float(s[i])) for i in order if ids[i] != q][:k]
    return out


def test_query_recall_scores_and_order(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    vectors = {i: np.asarray(v, np.float64) for i, v in rows}
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in QUERIES["op8_nearest"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in got.items():
        assert [r.rank for r in near] == list(range(1, 21))
        assert all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in near)
        assert [(-r.score, r.vec_id) for r in near] == sorted((-r.score, r.vec_id) for r in near)
        hits += len({r.vec_id for r in near} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_rows_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (None, [3.0, 0.0]), (8, [-1.0, 2.0]), (20, [2.0, 1.0]), (9, [9.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"query": F.lit(1), "key": F.lit("x")})
    out = ann.search(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [
        (0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 2, 0.5), (0, 5, 8, -1.0),
        (20, 1, 0, 2.0), (20, 2, 1, 1.5), (20, 3, 2, 1.5), (20, 4, 2, 1.5), (20, 5, 8, 0.0),
    ]
    assert ann.search(df.limit(0), df, k=5).collect() == []
    assert ann.search(df, df.limit(0), k=5).collect() == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 9)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = df.where("vec_id % 10 = 0")
    one = sorted(map(tuple, ann.search(df, ask, k=5, rerank=400).collect()))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, ann.search(df, ask, k=5, rerank=400).collect())) == one
    want = brute(rows, range(0, 300, 10), 5)
    assert [(q, v) for q, _, v, _ in one] == [(q, v) for q in sorted(want) for v, _ in want[q]]


def test_codes_weigh_the_parallel_residual():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 8)).astype(np.float32)
    c = ann.fit_centres(x)
    codes = ann.encode(x, c)
    parts = np.stack([c[j][codes[:, j]] for j in range(4)], 1).reshape(len(x), -1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    plain = np.stack([((x.reshape(-1, 4, 2)[:, j, None] - c[j][None]) ** 2).sum(2).argmin(1) for j in range(4)], 1)
    near = np.stack([c[j][plain[:, j]] for j in range(4)], 1).reshape(len(x), -1)
    along = lambda y: ((unit * (x - y)).sum(1) ** 2).mean()
    assert along(parts) < 0.9 * along(near)
    lut = ann.tables(x[:3].astype(np.float64), c)
    packed = ann.pack(codes)
    score = sum(lut[j][packed[:, j]] for j in range(len(lut)))
    assert np.allclose(score.T, x[:3] @ parts.T, atol=1e-3)


def test_doubles_are_scored_in_double_and_lengths_apart(spark):
    rows = [(0, [1.0, 1e300]), (1, [1e-3, 0.1]), (2, [0.1, 1e-300]), (20, [3.0]), (3, [0.1]), (4, [-2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(map(tuple, ann.search(df, df.where("vec_id % 20 = 0"), k=5).collect()))
    assert out == [(0, 1, 1, 1e-3 + 0.1 * 1e300), (0, 2, 2, 0.1 + 1.0), (20, 1, 3, 3.0 * 0.1), (20, 2, 4, -6.0)]


def test_recall_on_many_vectors():
    """120,000 vectors without structure, the hardest case, and in clusters; depth as search() takes it."""
    rng = np.random.default_rng(11)
    n, dim = 120_000, 64
    plain = rng.normal(size=(n, dim)).astype(np.float32)
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    near = (plain[rng.integers(0, 500, n)] + 0.3 * plain).astype(np.float32)
    for x in (plain, near):
        centres = ann.fit_centres(x[: ann.SAMPLE])
        codes = np.concatenate([ann.pack(ann.encode(x[a : a + 20_000], centres)) for a in range(0, n, 20_000)])
        ask = rng.choice(n, 40, replace=False)
        lut = ann.tables(x[ask].astype(np.float64), centres)
        approx = sum(lut[j][codes[:, j]] for j in range(len(lut)))
        exact = x.astype(np.float64) @ x[ask].T.astype(np.float64)
        hits = 0
        for i, q in enumerate(ask):
            exact[q, i] = approx[q, i] = -np.inf
            want = set(np.argpartition(-exact[:, i], 20)[:20].tolist())
            kept = np.argpartition(-approx[:, i], ann.depth(n))[: ann.depth(n)]
            hits += len(want & set(kept[np.argsort(-exact[kept, i])[:20]].tolist()))
        assert hits / (20 * len(ask)) >= 0.9


def test_exact_where_codes_cannot_tell(spark):
    """Tight clusters, lengths that differ widely, whole numbers with many equal scores, one id on several vectors."""
    rng = np.random.default_rng(23)
    tight = rng.normal(size=(3, 16))[rng.integers(0, 3, 3_000)] + 1e-4 * rng.normal(size=(3_000, 16))
    long = rng.normal(size=(3_000, 16)) * rng.lognormal(0, 3, (3_000, 1))
    whole = rng.integers(-1, 2, (3_000, 6)).astype(float)
    for x in (tight, long, whole):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32)) if row.any()]
        rows.append((40, [float(v) for v in x[1].astype(np.float32) + 1]))
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        ids, base = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
        want = {}
        for q in (i for i, _ in rows if i % 200 == 40 and i != 40):
            s = ann.inner_products(np.broadcast_to(base[ids == q][0], base.shape), base)
            want[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        got = {}
        for r in ann.search(df, df.where("vec_id % 200 = 40 and vec_id <> 40"), k=20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == want
