"""Images from tables: vectors, event heat maps and key grids as blocks and pixel tables; files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8  # of an image made of a vector of 64 numbers


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 block for each row of embeddings, levels 0 to 255. Never shuffled."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    level = F.transform("embedding", lambda e: F.floor((e.cast("double") + 0.6) * 200).cast("double"))
    return df.select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"), level.alias("data"))


def grid_image(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """One image of lineitem: quantity by part and order key, modulo the side."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = li.groupBy((F.col("l_partkey") % side).cast("int").alias("y"), (F.col("l_orderkey") % side).cast("int").alias("x")).agg((F.floor(F.sum("l_quantity")) % 256).cast("double").alias("v"))
    grid = spark.range(side * side).select(F.expr(f"cast(id div {side} as int)").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    return grid.join(cells, ["y", "x"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def colour_pixels(pixels: DataFrame) -> DataFrame:
    """Planes of three images in a row as c1, c2, c3; an incomplete last group is left out."""
    g = pixels.groupBy(F.expr("image_id div 3").alias("image_id"), "y", "x")
    c = [F.max(F.when(F.col("image_id") % 3 == k, F.col("v"))).alias(f"c{k + 1}") for k in range(3)]
    return g.agg(*c).where("c1 is not null and c2 is not null and c3 is not null")


def colour_blocks(blocks: DataFrame) -> DataFrame:
    """The same as blocks: data, d2, d3."""
    g = blocks.groupBy(F.expr("image_id div 3").alias("image_id"), "rows", "cols")
    c = [F.max_by("data", F.when(F.col("image_id") % 3 == k, F.lit(1))).alias(n) for k, n in enumerate(("data", "d2", "d3"))]
    return g.agg(*c).where("data is not null and d2 is not null and d3 is not null")


def read_images(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """Raw 8-bit files of one extent (binaryFile) as blocks; a file of another length has null data."""
    f = spark.read.format("binaryFile").load(path)
    level = F.transform(F.sequence(F.lit(1), F.lit(rows * cols)), lambda i: F.conv(F.hex(F.substring("content", i, F.lit(1))), 16, 10).cast("double"))
    return f.select(F.xxhash64("path").alias("image_id"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.when(F.col("length") == rows * cols, level).alias("data"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").parquet(path)


def dump_csv(pixels: DataFrame, path: str) -> None:
    pixels.write.mode("overwrite").option("header", True).csv(path)
