"""Maximum inner product search, exact by matrix products, or by score-aware quantisation, four-bit table scans
and exact reranking.

The exact way is the default, and that of the query: each task multiplies its distinct vectors with a block of
queries, and whatever the products' rounding errors leave in doubt is scored again, row by row. A task holds k
rows of each query of the block, and the k-th score so far excludes nearly all that comes later.

With a number for rerank the search is approximate: it misses neighbours where many vectors differ by less than
the codes can tell. Vectors are cut into pieces of PIECE dimensions, each coded by one of 16 centres (four bits). Codes and
centres minimise the anisotropic loss: the residual's part parallel to the vector, which shifts the
scores of the queries that matter, weighs ETA times its orthogonal part. Centres are fitted on a sample
of at most SAMPLE distinct vectors, those of least hash; every row is indexed. The index is a table of
packed codes in the shared folder.

Queries are taken in blocks. A block's tables of inner products with the centres are small and go to
every task; each task scans its codes and sends, for each query, the numbers and approximate scores of
its best entries, as many as depth() says: RERANK, and half the root of the number of entries where that
is more. Of all tasks' the best as many are joined with their vectors and scored exactly (inner product in
double precision, summed in order of dimensions), and the best k stay. Equal vectors are one entry with
their smallest k + 1 ids, which are all that a result of k can show, so a vector that many rows share
fills no list.

Vectors null, zero or with null or non-finite components take no part, nor do null ids. Vectors of
different lengths have no inner product: each length is searched on its own, so every other row takes
part. Components keep the precision of their column, float or double. Ties go to the smaller id; with
fewer candidates than k all are returned. Repeated ids are candidates each. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import discard, stage_table

PIECE, CENTRES = 2, 16
ETA, ROUNDS = 4.0, 12
SAMPLE = 20_000
QUERY_BLOCK = 2_048
EXACT_ROWS = 1_024  # of a product with the queries of a block
RERANK = 200
SCAN_ROWS = 2_048
EPS, TINY = np.finfo(np.float64).eps, np.finfo(np.float64).tiny


def fit_centres(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centres (pieces, 16, PIECE) that minimise the anisotropic loss on the rows of x, by alternating
    coding (piece by piece, the others held) and the closed form of each piece's centres."""
    n, d = x.shape
    m = d // PIECE
    parts = x.reshape(n, m, PIECE).astype(np.float64)
    rng = np.random.default_rng(seed)
    start = rng.choice(n, CENTRES, replace=n < CENTRES)
    centres = np.ascontiguousarray(parts[start].transpose(1, 0, 2))
    codes = np.stack([((parts[:, j, None] - centres[j][None]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    for _ in range(ROUNDS):
        codes = encode(x, centres, codes)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        resid = parts - np.stack([centres[j][codes[:, j]] for j in range(m)], 1)
        along = np.einsum("nmp,nmp->n", unit, resid)
        for j in range(m):
            u, r = unit[:, j], parts[:, j]
            other = along - np.einsum("np,np->n", u, resid[:, j])  # parallel residual of the other pieces
            for c in range(CENTRES):
                at = codes[:, j] == c
                if at.any():
                    uu = np.einsum("np,nq->pq", u[at], u[at])
                    a = at.sum() * np.eye(PIECE) + (ETA - 1) * uu
                    rhs = r[at].sum(0) + (ETA - 1) * (u[at] * (np.einsum("np,np->n", u[at], r[at]) + other[at])[:, None]).sum(0)
                    centres[j, c] = np.linalg.solve(a, rhs)
            new = r - centres[j][codes[:, j]]
            along = other + np.einsum("np,np->n", u, new)
            resid[:, j] = new
    return centres


def encode(x: np.ndarray, centres: np.ndarray, codes: np.ndarray | None = None, passes: int = 2) -> np.ndarray:
    """Codes of the rows: each piece takes the centre of least loss with the other pieces held."""
    n, m = len(x), len(centres)
    parts = x.reshape(n, m, PIECE).astype(np.float64)
    unit = parts / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1), 1e-30)[:, None, None]
    if codes is None:
        codes = np.stack([((parts[:, j, None] - centres[j][None]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    codes = codes.copy()
    along = sum(np.einsum("np,np->n", unit[:, j], parts[:, j] - centres[j][codes[:, j]]) for j in range(m))
    for _ in range(passes):
        for j in range(m):
            r = parts[:, j, None] - centres[j][None]
            proj = np.einsum("np,ncp->nc", unit[:, j], r)
            other = along - proj[np.arange(n), codes[:, j]]
            loss = (r**2).sum(2) + (ETA - 1) * (other[:, None] + proj) ** 2
            codes[:, j] = loss.argmin(1)
            along = other + proj[np.arange(n), codes[:, j]]
    return codes


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each byte of a code and each query, the sum of both pieces' products: (bytes, 256, queries)."""
    lut = np.einsum("qmp,mcp->mcq", queries.reshape(len(queries), len(centres), PIECE), centres)
    if len(lut) % 2:
        lut = np.concatenate([lut, np.zeros_like(lut[:1])])
    lo, hi = lut[::2], lut[1::2]
    return (lo[:, None, :, :] + hi[:, :, None, :]).reshape(len(lo), 256, -1).astype(np.float32)


def depth(entries: int, least: int = RERANK) -> int:
    """How many entries of each query are scored exactly."""
    return max(least, math.isqrt(entries) // 2)


def _good(df: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    v = F.col(vec_col).cast(f"array<{kind}>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(col: pa.Array) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def _distinct(good: DataFrame, keep: int) -> DataFrame:
    """v and ids: distinct vectors with their keep smallest ids; partitions give keep of theirs at most."""

    def local(batches):
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), _matrix(b.column(1)) + 0, strict=True):  # -0.0 is 0.0
                h = held.setdefault(row.tobytes(), [])
                if len(h) < keep:
                    heapq.heappush(h, -i)
                elif -i > h[0]:
                    heapq.heapreplace(h, -i)
        keys = list(held)
        for a in range(0, len(keys), 8_192):
            part = keys[a : a + 8_192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([sorted(-i for i in held[k]) for k in part], pa.list_(pa.int64()))], ["key", "ids"]
            )

    parts = good.mapInArrow(local, "key binary, ids array<long>")
    return parts.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))


def search(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest rows of base but itself. rerank: the
    least number of entries that the approximate search scores exactly; None for the exact search."""
    floats = all(df.select(vec_col).dtypes[0][1] == "array<float>" for df in (base, queries))
    kind = "float" if floats else "double"
    good, asked = _good(base, id_col, vec_col, kind), _good(queries, id_col, vec_col, kind)
    result = base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in good.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # few: the lengths of vectors
        result = result.union(_search(good.where(F.size("v") == r.d), asked.where(F.size("v") == r.d), r.d, np.dtype(f"<f{4 if floats else 8}"), k, rerank))
    return result


def _search(good: DataFrame, asked: DataFrame, dim: int, kind: np.dtype, k: int, rerank: int | None) -> DataFrame:
    """The same among vectors of one length."""
    spark, schema = good.sparkSession, "query_id long, rank int, vec_id long, score double"
    entries = stage_table(_distinct(good, k + 1), "vectors")
    size, find = _exact(entries, dim, kind, k) if rerank is None else _approximate(entries, dim, kind, rerank)

    def run(block) -> DataFrame:
        near = find([q for q, _ in block], np.asarray([v for _, v in block], kind))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out, block = [], []
    for r in asked.toLocalIterator():
        block.append((r.vec_id, r.v))
        if len(block) == size:
            out.append(stage_table(run(block), "nearest"))
            block = []
    if block or not out:
        out.append(run(block) if block else spark.createDataFrame([], schema))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _exact(entries: DataFrame, dim: int, kind: np.dtype, k: int):
    """How many queries a block has, and what finds candidates of a block, among them each query's k nearest."""
    spark = entries.sparkSession

    def find(names, q) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.asarray(names, np.int64), q))
        return entries.mapInArrow(_exact_scan(shared, dim, kind, k), "query_id long, vec_id long, score double")

    return QUERY_BLOCK, find


def _approximate(entries: DataFrame, dim: int, kind: np.dtype, rerank: int):
    """The same for the candidates that the codes find."""
    spark = entries.sparkSession
    even = -(-dim // PIECE) * PIECE
    sample = entries.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("key").toArrow().column(0).to_pylist()

    def rows_of(keys) -> np.ndarray:
        x = np.frombuffer(b"".join(keys), kind).reshape(-1, dim)
        return np.pad(x, ((0, 0), (0, even - dim)))

    centres = fit_centres(rows_of(sample))

    def index(batches):
        for b in batches:
            if b.num_rows:
                codes = pack(encode(rows_of(b.column(0).to_pylist()), centres))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "ids", "code"])

    indexed = entries.mapInArrow(index, "key binary, ids array<long>, code binary")
    indexed = stage_table(indexed.withColumn("entry", F.monotonically_increasing_id()), "vector-index")  # numbered once, as written
    discard(entries)
    rerank = depth(indexed.count(), rerank)

    def find(names, q) -> DataFrame:
        shared = spark.sparkContext.broadcast((names, q, centres))
        near = indexed.select("entry", "code").mapInArrow(_scan(shared, rerank, even), "query int, entry long, approx float")
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("approx"), "entry"))
        near = near.withColumn("r", best).where(F.col("r") <= rerank).select("query", "entry")
        near = near.join(indexed.select("entry", "key", "ids"), "entry").select("query", "key", "ids")
        return near.mapInArrow(_score(shared), "query_id long, vec_id long, score double")

    return max(1, QUERY_BLOCK * RERANK // rerank), find  # lists of a block stay of one size


def _exact_scan(shared, dim: int, kind: np.dtype, k: int):
    def run(batches):
        names, q = shared.value
        wide, n = q.astype(np.float64), len(q)
        by_name = np.argsort(names, kind="stable")
        which, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # k rows of each query at most
        least = np.full(n, -np.inf)  # the k-th score of each query so far
        for b in batches:
            for a in range(0, b.num_rows, EXACT_ROWS):
                keys, owners = (b.column(i).slice(a, EXACT_ROWS) for i in range(2))
                x = np.frombuffer(b"".join(keys.to_pylist()), kind).reshape(-1, dim)
                count = owners.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                own, first = owners.flatten().to_numpy(zero_copy_only=False), np.cumsum(count) - count
                with np.errstate(all="ignore"):
                    approx = x.astype(np.float64) @ wide.T  # NaN, where sums overflow, counts as the greatest
                    error = 4 * (dim + 2) * (EPS * np.abs(x).max().astype(np.float64) * np.abs(wide).sum(1) + TINY)
                alone = np.flatnonzero(own[first] == own[first + count - 1])  # ids are sorted: the entries of one id
                lo, hi = (np.searchsorted(names[by_name], own[first[alone]], side) for side in ("left", "right"))
                for e in np.flatnonzero(hi > lo):
                    approx[alone[e], by_name[lo[e] : hi[e]]] = -np.inf  # the query itself
                with np.errstate(all="ignore"):
                    bound = least - error
                    if len(x) > k:
                        many = np.flatnonzero((~(approx < bound)).sum(0) > 4 * k)
                        kth = np.partition(approx[:, many], len(x) - k, axis=0)[len(x) - k]
                        bound[many] = np.where(np.isnan(kth), -np.inf, np.fmax(bound[many], kth - 2 * error[many]))
                    cand, of = np.nonzero(~(approx < bound))
                for part in range(0, len(cand), 1 << 16):
                    c, o = cand[part : part + (1 << 16)], of[part : part + (1 << 16)]
                    with np.errstate(all="ignore"):
                        s = inner_products(q[o], x[c])
                    each = np.repeat(np.arange(len(c)), count[c])
                    at = first[c][each] + np.arange(len(each)) - np.repeat(np.cumsum(count[c]) - count[c], count[c])
                    other = own[at] != names[o[each]]
                    which = np.concatenate([which, o[each][other]])
                    ids, score = np.concatenate([ids, own[at][other]]), np.concatenate([score, s[each][other]])
                    order = np.lexsort((ids, -score, ~np.isnan(score), which))
                    which, ids, score = which[order], ids[order], score[order]
                    place = np.arange(len(which)) - np.searchsorted(which, which)
                    full = which[place == k - 1], score[place == k - 1]
                    least[full[0]] = full[1]
                    which, ids, score = (v[place < k] for v in (which, ids, score))
        for a in range(0, len(which), 1 << 14):
            part = slice(a, a + (1 << 14))
            yield pa.RecordBatch.from_arrays([pa.array(names[which[part]]), pa.array(ids[part]), pa.array(score[part])], ["query_id", "vec_id", "score"])

    return run


def _scan(shared, rerank: int, even: int):
    def run(batches):
        _, q, centres = shared.value
        q = np.pad(q, ((0, 0), (0, even - q.shape[1]))).astype(np.float64)
        lut = tables(q, centres)
        n = len(q)
        top = np.full((n, 0), -np.inf, np.float32)
        at = np.zeros((n, 0), np.int64)
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            entry = b.column(0).to_numpy()
            for a in range(0, len(codes), SCAN_ROWS):
                part = codes[a : a + SCAN_ROWS]
                score = lut[0][part[:, 0]]
                for j in range(1, len(lut)):
                    score += lut[j][part[:, j]]
                score = np.concatenate([top, score.T], 1)
                where = np.concatenate([at, np.broadcast_to(entry[a : a + len(part)], (n, len(part)))], 1)
                if score.shape[1] > rerank:
                    pick = np.argpartition(-score, rerank - 1, axis=1)[:, :rerank]
                    score, where = np.take_along_axis(score, pick, 1), np.take_along_axis(where, pick, 1)
                top, at = score, where
        width = at.shape[1]
        for a in range(0, n if width else 0, 64):
            part = slice(a, min(a + 64, n))
            which = np.repeat(np.arange(part.start, part.stop, dtype=np.int32), width)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(at[part].ravel()), pa.array(top[part].ravel())], ["query", "entry", "approx"])

    return run


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed dimension by dimension, so equal vectors score alike."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[:, d].astype(np.float64) * x[:, d].astype(np.float64)
    return out


def _score(shared):
    def run(batches):
        names, q, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            which = b.column(0).to_numpy()
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), q.dtype).reshape(b.num_rows, -1)
            score = inner_products(q[which], x)
            rows = [(names[i], v, s) for i, own, s in zip(which, b.column(2).to_pylist(), score, strict=True) for v in own if v != names[i]]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


ORACLE = """
with e as (select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
