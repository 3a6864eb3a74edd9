"""Histogram matching on blocks: the histogram of an image and its 256 levels stay in one row, so nothing grows
but the pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = 1_024  # whose histograms are made at a time
SHARES = 4_096  # that meet the target's at a time


def nearest_levels(share: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each share the first level of the target whose share is nearest; gaps within 1e-12 are equal."""
    out = np.empty(len(share), np.int64)
    for a in range(0, len(share), SHARES):
        gap = np.abs(share[a : a + SHARES, None] - target)
        out[a : a + SHARES] = (gap <= gap.min(1, keepdims=True) + 1e-12).argmax(1)
    return out


def match_histogram(images: DataFrame, target: DataFrame, bins: int = 256) -> DataFrame:
    """image_id, y, x, v of the pixels of blocks, as pixels.match_histogram. target: bin, cnt of each of the bins.
    Blocks of one id are one image; those of none give nothing. Without a pixel under 256 all levels become 0."""
    count = np.array([r.cnt for r in target.orderBy("bin").collect()], float)
    share = np.cumsum(count) / count.sum()

    def matched(image: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        v = np.nan_to_num(v)  # a null counts as 0, as in the SQL
        at, level = (np.maximum(np.floor(e), 0) for e in (v * (bins / 256) + 0.001, v))
        inside = at < bins
        up = np.bincount(image[inside] * bins + at[inside].astype(np.int64), minlength=n * bins).reshape(n, bins).cumsum(1)
        p = up[image, np.minimum(level, bins - 1).astype(np.int64)] / np.maximum(up[image, -1], 1)
        values, which = np.unique(p, return_inverse=True)
        return np.where(up[image, -1] > 0, nearest_levels(values, share)[which], 0).astype(float)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, IMAGES):
                ids, blocks = (b.column(i).slice(a, IMAGES) for i in range(2))
                of = np.repeat(np.arange(len(ids)), blocks.value_lengths().to_numpy(zero_copy_only=False))
                cols, data = blocks.flatten().flatten()
                size = data.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                image, width = np.repeat(of, size), np.repeat(cols.to_numpy(zero_copy_only=False), size)
                v = matched(image, data.flatten().to_numpy(zero_copy_only=False), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(image)), pa.array((p // width).astype(np.int32)), pa.array((p % width).astype(np.int32)), pa.array(v)], ["image_id", "y", "x", "v"]
                )

    one = images.where("image_id is not null and data is not null").groupBy(F.col("image_id").cast("long").alias("image_id"))
    return one.agg(F.collect_list(F.struct(F.col("cols").cast("int"), F.col("data").cast("array<double>")))).mapInArrow(run, "image_id long, y int, x int, v double")
