"""Palettes by the batch rule with a shrinking neighbourhood. The palette is a grid of at most 256 colours; each
iteration is one pass over the distinct colours of the pixel table, whose sums are all that comes to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import discard, stage_table
from gridlake.operators import pixels as P

TASKS = 12  # of a pass: few bytes, many distances
PIXELS = 512  # that meet the palette at a time, so that the stacks stay in a core's cache


def delta_e76(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b."""
    return ((a[:, None] - b[None]) ** 2).sum(-1)


def delta_e2000(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As pixels.delta_e2000, of every row of a to every row of b."""
    return _delta_e2000(a[:, None], b[None])


def _delta_e2000(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of rows that broadcast. Powers are products, and cosines of multiples of the mean hue come from one
    cosine and one sine."""
    (l1, s1, b1), (l2, s2, b2) = (np.moveaxis(k, -1, 0) for k in (a, b))

    def share(c):
        c7 = c * c
        c7 = c7 * c7 * c7 * c
        return np.sqrt(c7 / (c7 + 25.0**7))

    g = (1 - share((np.sqrt(s1 * s1 + b1 * b1) + np.sqrt(s2 * s2 + b2 * b2)) / 2)) / 2
    a1, a2 = s1 * (1 + g), s2 * (1 + g)
    q1, q2 = np.sqrt(a1 * a1 + b1 * b1), np.sqrt(a2 * a2 + b2 * b2)
    turn = 2 * np.pi
    h1, h2 = (np.where(h < 0, h + turn, h) for h in (np.arctan2(b1, a1), np.arctan2(b2, a2)))
    close, gap = np.abs(h1 - h2) <= np.pi, h2 - h1
    dh = 2 * np.sqrt(q1 * q2) * np.sin(np.where(close, gap, np.where(gap > 0, gap - turn, gap + turn)) / 2)
    ah = np.where((q1 == 0) | (q2 == 0), h1 + h2, np.where(close, (h1 + h2) / 2, (h1 + h2 + turn) / 2))
    al, ac = ((l1 + l2) / 2 - 50) ** 2, (q1 + q2) / 2
    c, s = np.cos(ah), np.sin(ah)
    c2, s2 = c * c - s * s, 2 * s * c
    c3, s3, c4, s4 = c2 * c - s2 * s, s2 * c + c2 * s, c2 * c2 - s2 * s2, 2 * s2 * c2
    cosine = lambda ck, sk, by: ck * np.cos(by) - sk * np.sin(by)
    t = 1 - 0.17 * cosine(c, s, -np.pi / 6) + 0.24 * c2 + 0.32 * cosine(c3, s3, np.pi / 30) - 0.2 * cosine(c4, s4, -np.pi * 63 / 180)
    dl, dc, dh = (l2 - l1) / (1 + 0.015 * al / np.sqrt(20 + al)), (q2 - q1) / (1 + 0.045 * ac), dh / (1 + 0.015 * ac * t)
    rt = -2 * share(ac) * np.sin(np.pi / 3 * np.exp(-(((np.degrees(ah) - 275) / 25) ** 2)))
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + rt * dc * dh, 0.0))


def nearest(px: np.ndarray, palette: np.ndarray, ciede2000: bool) -> np.ndarray:
    """The first colour of least distance, rounded to six places, for each pixel.

    For CIEDE2000 few colours need the whole formula: the part of the lightness alone is a lower bound, as what it
    leaves, c^2 + h^2 + r c h, isn't negative with |r| under 2. The colour of least bound and chroma gap gives a distance
    to beat; colours whose bound is greater, by more than the rounding, can't be the nearest."""
    if not ciede2000:
        return np.round(delta_e76(px, palette), 6).argmin(-1)
    l1, l2 = px[:, :1], palette[None, :, 0]
    al = ((l1 + l2) / 2 - 50) ** 2
    bound = np.abs(l2 - l1) / (1 + 0.015 * al / np.sqrt(20 + al))
    guess = (bound**2 + ((px[:, None, 1:] - palette[None, :, 1:]) ** 2).sum(-1) / 4).argmin(-1)
    best = _delta_e2000(px, palette[guess])
    i, j = np.nonzero(bound <= best[:, None] + 1e-5)
    d = np.full(bound.shape, np.inf)
    d[i, j] = np.round(_delta_e2000(px[i], palette[j]), 6)
    return d.argmin(-1)


def radius(i: int, iterations: int, rows: int, cols: int, use_8: bool) -> int:
    if i < iterations // 8 and rows >= 5 and cols >= 5:
        return 2
    return int(i < iterations // 2 and (rows >= 3 or not use_8))


def spread(sums: np.ndarray, reach: int, use_8: bool) -> np.ndarray:
    """sums (rows, cols, k): each cell also goes to its neighbours, in a square or else a diamond."""
    rows, cols = sums.shape[:2]
    out = np.zeros_like(sums)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if (use_8 or abs(dy) + abs(dx) <= reach) and abs(dy) < rows and abs(dx) < cols:
                to = np.s_[max(dy, 0) : rows + min(dy, 0), max(dx, 0) : cols + min(dx, 0)]
                out[to] += sums[max(-dy, 0) : rows + min(-dy, 0), max(-dx, 0) : cols + min(-dx, 0)]
    return out


def _sums(pixels: DataFrame, palette: np.ndarray, ciede2000: bool) -> np.ndarray:
    """Sums of rounded channels, and numbers, of the pixels nearest to each colour (the first of equal ones). pixels:
    c1, c2, c3 and n, how many have them."""
    size = len(palette)

    def run(batches):
        total = np.zeros((size, 4), np.int64)
        for b in batches:
            every = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], -1)
            many = b.column(3).to_numpy(zero_copy_only=False)
            for px, n in ((every[i : i + PIXELS], many[i : i + PIXELS]) for i in range(0, len(every), PIXELS)):
                near = nearest(px, palette, ciede2000)
                whole = np.copysign(np.floor(np.abs(px) + 0.5), px).astype(np.int64)
                order = np.argsort(near, kind="stable")
                found, first = np.unique(near[order], return_index=True)
                total[found] += np.add.reduceat((np.concatenate([whole, np.ones((len(px), 1), np.int64)], 1) * n[:, None])[order], first)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *(pa.array(total[:, k].copy()) for k in range(4))], ["idx", "s1", "s2", "s3", "n"])

    found = pixels.mapInArrow(run, "idx long, s1 long, s2 long, s3 long, n long").groupBy("idx").agg(*(F.sum(k).alias(k) for k in ("s1", "s2", "s3", "n")))
    out = np.zeros((size, 4))
    for r in found.collect():
        out[r.idx] = r.s1, r.s2, r.s3, r.n
    return out


def generate(pixels: DataFrame, rows: int, cols: int, iterations: int, use_8: bool = False, ciede2000: bool = False) -> DataFrame:
    """idx, c1, c2, c3 of a palette of rows x cols colours trained on all pixels (c1, c2, c3); a colour that
    no pixel reaches stays. Pixels with a null channel count for nothing; without pixels there is no palette."""
    spark, schema = pixels.sparkSession, "idx int, c1 double, c2 double, c3 double"
    px = pixels.select(*(F.col(c).cast("double").alias(c) for c in ("c1", "c2", "c3"))).dropna()
    px = px.groupBy("c1", "c2", "c3").agg(F.count("*").alias("n")).repartition(TASKS)
    px = stage_table(px, "colours")
    try:
        first = sorted(P.run(P.initial_palette(rows * cols), c=px).collect(), key=lambda r: r.idx)
        if any(r.c1 is None for r in first):
            return spark.createDataFrame([], schema)
        palette = np.array([[r.c1, r.c2, r.c3] for r in first], float)
        for i in range(iterations):
            s = spread(_sums(px, palette, ciede2000).reshape(rows, cols, 4), radius(i, iterations, rows, cols, use_8), use_8).reshape(-1, 4)
            palette = np.where(s[:, 3:] > 0, s[:, :3] / np.maximum(s[:, 3:], 1), palette)
    finally:
        discard(px)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(palette.tolist())], schema)
