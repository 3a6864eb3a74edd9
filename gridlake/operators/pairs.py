"""All pairs of two tables of vectors (id, data array<double>), in blocks of rows.

Rows are packed into blocks, every block of one table meets every block of the other, and a kernel sees
two matrices. Sums of products are matrix products; what is left goes dimension by dimension over small whole
numbers. Results are rounded in the kernels' stacks, as rounding row by row in Spark costs more than the rest. A null
vector is in no pair; vectors of unequal lengths are compared as far as both reach.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_up

ROWS = 512  # of a block
PARTS = 24  # of either side: tasks where one side is broadcast; their square where none is
TILE = 256  # rows of the first matrix that a kernel sees
_PACKED = "ids array<long>, width int, data array<double>"


def _pack(vectors: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            width = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                for at in (of[i : i + ROWS] for i in range(0, len(of), ROWS)):
                    part = b.take(pa.array(at, pa.int64()))
                    columns = [part.column(0).to_pylist()], [int(w)], [part.column(1).flatten()]
                    kinds = pa.list_(pa.int64()), pa.int32(), pa.list_(pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "width", "data"])

    picked = vectors.toDF("id", "data").select(F.col("id").cast("long"), F.col("data").cast("array<double>")).where("size(data) > 0")
    return picked.mapInArrow(run, _PACKED).repartition(parts)  # blocks are dealt, so that no later task packs again


def all_pairs(
    a: DataFrame, b: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, float | None], np.ndarray], extra: DataFrame | None = None, places: int | None = None
) -> DataFrame:
    """a_id, b_id, v = kernel(rows of a, rows of b, extra) -> matrix. extra: a table of one number, for all pairs.
    places: of the rounding of v, if any."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                sides = []
                for i in (0, 3):
                    ids, data = (batch.column(i + k)[r].values.to_numpy(zero_copy_only=False) for k in (0, 2))
                    sides.append((ids, data.reshape(len(ids), -1)))
                (ia, va), (ib, vb) = sides
                w, e = min(va.shape[1], vb.shape[1]), batch.column(6)[r].as_py()
                for t in range(0, len(ia), TILE):
                    own = ia[t : t + TILE]
                    v = np.asarray(kernel(va[t : t + TILE, :w], vb[:, :w], e), float)
                    v = v if places is None else round_half_up(v, places)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(ib))), pa.array(np.tile(ib, len(own))), pa.array(v.ravel())], ["a_id", "b_id", "v"])

    left, right = _pack(a, PARTS).toDF("ia", "wa", "da"), _pack(b, PARTS).toDF("ib", "wb", "db")
    both = left.crossJoin(right)
    both = both.crossJoin(F.broadcast(extra.toDF("extra"))) if extra is not None else both.withColumn("extra", F.lit(None))
    return both.withColumn("extra", F.col("extra").cast("double")).mapInArrow(run, "a_id long, b_id long, v double")


def distance(a: np.ndarray, b: np.ndarray, _=None) -> np.ndarray:
    """By products; where the difference of sums has lost digits, by differences."""
    with np.errstate(all="ignore"):
        both = (a * a).sum(-1)[:, None] + (b * b).sum(-1)
        square = both - 2 * (a @ b.T)
        close = np.nonzero(~((square > 1e-4 * both) & (both > 1e-200) & (both < 1e300)))  # also what isn't finite
    for part in range(0, len(close[0]), 1 << 14):
        i, j = (k[part : part + (1 << 14)] for k in close)
        with np.errstate(all="ignore"):
            square[i, j] = ((a[i] - b[j]) ** 2).sum(-1)
    return np.sqrt(square)


def over(t: float) -> Callable[..., np.ndarray]:
    """How many places differ by more than t."""

    def count(a: np.ndarray, b: np.ndarray, _=None) -> np.ndarray:
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            return (np.abs(a[:, None] - b[None]) > t).sum(-1)
        first, last, rank = _within(a, b, t)
        near, shifted, inside = (np.empty((len(a), len(b)), k) for k in (np.uint8 if a.shape[1] < 1 << 8 else np.int64, np.uint16, bool))
        near[:] = 0
        for k in range(a.shape[1]):
            np.subtract(rank[k], first[k, :, None], out=shifted)  # ranks under the first wrap around
            np.less(shifted, (last - first)[k, :, None], out=inside)
            near += inside
        return a.shape[1] - near.astype(np.int64)

    return count


def _within(a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place and each row of a, the ranks of b's rows from first to before last are those that differ by t at
    most: rounded differences grow with b, so these are a run, whose ends are looked up and then moved to where the
    differences say."""
    a, b, n = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), len(b)
    order = np.argsort(b, 1)
    rank = np.empty(b.shape, np.uint16)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.uint16)[None], 1)
    b = np.take_along_axis(b, order, 1)
    out = []
    for side, shift, outside in (("left", -t, lambda d: d < -t), ("right", t, lambda d: d <= t)):
        at = np.stack([np.searchsorted(own, x + shift, side) for own, x in zip(b, a, strict=True)])
        while (move := (at > 0) & ~outside(np.take_along_axis(b, np.maximum(at - 1, 0), 1) - a)).any():
            at -= move
        while (move := (at < n) & outside(np.take_along_axis(b, np.minimum(at, n - 1), 1) - a)).any():
            at += move
        out.append(at.astype(np.uint16))
    return out[0], out[1], rank


def _correlation(a, b, mean):
    a, b = a - mean, b - mean
    d = (a * a).sum(-1)[:, None] * (b * b).sum(-1)[None]
    return np.where(d == 0, 1.0, (a @ b.T) / np.sqrt(np.where(d == 0, 1.0, d)))


def _chi_square(a, b, _=None):
    """Sums of (x - y)^2 / x = x - 2 y + y^2 / x where x > 0."""
    held = a > 0
    full = np.where(held, a, 0.0).sum(-1)[:, None] - 2 * (held.astype(float) @ b.T)
    return np.maximum(full + np.where(held, 1 / np.where(held, a, 1.0), 0.0) @ (b * b).T, 0.0)


def _hellinger(a, b, _=None):
    norm = np.sqrt(a.sum(-1)[:, None] * b.sum(-1)[None])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(np.maximum(1.0 - np.sqrt(a) @ np.sqrt(b).T / norm, 0.0))


def _intersect(a, b, _=None):
    """Sums of the smaller one, bin by bin, over the narrowest whole numbers that hold all."""
    top = max(a.max(), b.max())
    if not (min(a.min(), b.min()) >= 0 and top < 1 << 31 and (a == np.floor(a)).all() and (b == np.floor(b)).all()):
        return np.minimum(a[:, None], b[None]).sum(-1)
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
    size = min(a.sum(-1).max(), b.sum(-1).max())
    out = np.zeros((len(a), len(b)), np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.int64)
    a, b, least = a.astype(kind), np.ascontiguousarray(b.T.astype(kind)), np.empty((len(a), len(b)), kind)
    for k in range(len(b)):
        np.minimum(a[:, k, None], b[k], out=least)
        out += least
    return out.astype(float)


def _chebyshev(a, b, _=None):
    """|x - y| = x + y - 2 min(x, y)."""
    if not ((a == np.floor(a)).all() and (b == np.floor(b)).all()):
        return np.abs(a[:, None] - b[None]).sum(-1)
    return a.sum(-1)[:, None] + b.sum(-1)[None] - 2 * _intersect(a, b)


#: As pixels.compare_histograms: correlation takes the mean of the first histogram throughout, chebyshev is a sum.
HISTOGRAMS: dict[str, Callable[..., np.ndarray]] = {
    "correlation": _correlation,
    "chi_square": _chi_square,
    "intersect": _intersect,
    "chebyshev": _chebyshev,
    "hellinger": _hellinger,
}
