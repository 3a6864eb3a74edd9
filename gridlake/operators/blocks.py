"""Images as one row each: image_id, rows, cols, data (row-major array<double>).

A kernel sees a stack of all images of a batch that have the same extent, so small images cost no call
each; nothing is shuffled, as an image never leaves its row. Null data or an extent that doesn't fit
gives null data; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.rounding import round_half_up

STACK, SPREAD = 1 << 16, 96  # pixels that variants() makes at a time, and its tasks
BLOCK = "image_id long, rows int, cols int, data array<double>"
_NAMES = ["image_id", "rows", "cols", "data"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]


def _stacks(b: pa.RecordBatch, columns: list[int]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of one extent and their data as stacks, one for each of the columns."""
    rows, cols = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    shape: dict[tuple, list[int]] = {}
    for i in range(b.num_rows):
        datas = [b.column(c)[i] for c in columns]
        if all(d.is_valid and len(d.values) == rows[i] * cols[i] for d in datas):
            shape.setdefault((int(rows[i]), int(cols[i])), []).append(i)
    for (r, c), at in shape.items():
        pick = pa.array(at, pa.int64())
        yield np.asarray(at), [b.column(k).take(pick).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), r, c) for k in columns]


def map_blocks(images: DataFrame, kernel: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """kernel(stack, ...) -> stack, of any extent. more: further columns of data that the kernel takes."""
    columns = [3, *range(4, 4 + len(more))]

    def run(batches):
        for b in batches:
            data: list = [None] * b.num_rows
            extent = [list(b.column(i).to_pylist()) for i in (1, 2)]
            for at, stacks in _stacks(b, columns):
                out = np.asarray(kernel(*stacks), float)
                for i, image in zip(at, out, strict=True):
                    data[i] = image.ravel()
                    extent[0][i], extent[1][i] = image.shape
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip((*extent, data), _KINDS[1:], strict=True))], _NAMES)

    picked = images.select(F.col("image_id").cast("long"), F.col("rows").cast("int"), F.col("cols").cast("int"), *(F.col(c).cast("array<double>") for c in ("data", *more)))
    return picked.mapInArrow(run, BLOCK)


def rows_of_blocks(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """kernel(stack) -> for each image of the stack, columns of result rows; schema is theirs."""
    kinds = [x.split()[1] for x in schema.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, stacks in _stacks(b, [3]):
                for i, cols in zip(at, kernel(stacks[0]), strict=True):
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i]] * n, pa.int64()), *(pa.array(np.asarray(c).tolist(), arrow[k]) for c, k in zip(cols, kinds, strict=True))],
                        ["image_id", *(x.split()[0] for x in schema.split(", "))],
                    )

    picked = images.select(F.col("image_id").cast("long"), F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("data").cast("array<double>"))
    return picked.mapInArrow(run, f"image_id long, {schema}")


def variants(images: DataFrame, kernel: Callable[[np.ndarray, tuple], np.ndarray], grid: list[tuple], places: int | None = None) -> DataFrame:
    """tid and pixels of kernel(stack, grid[tid]) -> stack of the same extent, for every image and every tid. places:
    of the rounding of v, if any. Rows are made in stacks of STACK pixels: Spark has nothing left to do for a row. The
    images are dealt over SPREAD tasks first, as one small file gives many variants."""

    def run(batches):
        for b in batches:
            for at, (stack,) in _stacks(b, [3]):
                rows, cols = stack.shape[1:]
                step = max(1, STACK // max(rows * cols, 1))
                for i in range(0, len(at), step):
                    part, n = stack[i : i + step], min(step, len(at) - i)
                    ids = b.column(0).take(pa.array(np.repeat(at[i : i + step], rows * cols), pa.int64()))
                    y, x = (pa.array(np.tile(k.ravel().astype(np.int32), n)) for k in np.mgrid[:rows, :cols])
                    for tid, g in enumerate(grid):
                        v = np.asarray(kernel(part, g), float).ravel()
                        v = v if places is None else round_half_up(v, places)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), tid, np.int32)), ids, y, x, pa.array(v)], ["tid", "image_id", "y", "x", "v"])

    picked = images.select(F.col("image_id").cast("long"), F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("data").cast("array<double>"))
    return picked.repartition(SPREAD).mapInArrow(run, "tid int, image_id long, y int, x int, v double")


def to_pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, v of every pixel."""
    p = images.select("image_id", "cols", F.posexplode("data").alias("p", "v"))
    return p.select("image_id", F.expr("cast(p div cols as int)").alias("y"), (F.col("p") % F.col("cols")).cast("int").alias("x"), "v")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Blocks of dense pixel tables; a pixel that is missing makes the data null."""
    g = pixels.groupBy("image_id").agg(F.max("y").alias("r"), F.max("x").alias("c"), F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    rows, cols = (F.col("r") + 1).cast("int"), (F.col("c") + 1).cast("int")
    data = F.transform("p", lambda s: s["v"].cast("double"))
    return g.select("image_id", rows.alias("rows"), cols.alias("cols"), F.when(F.size("p") == rows * cols, data).alias("data"))
