"""A query with its oracle, and the relations that both engines build alike."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import blocks as B
from gridlake.operators import pixels as P
from gridlake.sources import images as I

#: How result columns are typed, in both engines; others are double.
TYPES = {k: "bigint" for k in "image_id label n m00 m01 m10 m02 m11 m20 cnt a_id b_id score votes hist_id vec_id roi_id mask area radius_votes".split()} | {
    k: "int" for k in "y x p bin idx thresh tid theta_idx".split()
}


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def doubles(text: str) -> str:
    """Decimal literals as doubles, as both engines read an exponent."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast(TYPES.get(c, "double")).alias(c) for c in columns))


def oracle(text: str, columns: list[str], **relations: str) -> str:
    """text over relations as SQL of the second engine."""
    text = P.numbers(text, "(select cast(range as integer) as bin from range({n}))")
    used: dict[str, str] = {}

    def add(name: str) -> None:
        if name in used:
            return
        body = relations.get(name) or RELATIONS[name]
        for other in re.findall(r"\{(\w+)\}", body):
            add(other)
        used[name] = P.numbers(re.sub(r"\{(\w+)\}", r"in_\1", body), "(select cast(range as integer) as bin from range({n}))")

    for name in re.findall(r"\{(\w+)\}", text):
        add(name)
    text = re.sub(r"\{(\w+)\}", r"in_\1", text)
    head = ", ".join(f"in_{n} as materialized (select * from ({b}) {n}_)" for n, b in used.items())
    cols = ", ".join(f"cast({c} as {TYPES.get(c, 'double')}) as {c}" for c in columns)
    return doubles(f"with {head} select {cols} from ({text}) result_")


#: For the second engine. px: 8 x 8 images; big: one 64 x 64 image; col: three planes; bin: thresholded px.
RELATIONS = {
    "px": "select vec_id as image_id, cast(i.range // 8 as integer) as y, cast(i.range % 8 as integer) as x, floor((cast(embedding[i.range + 1] as double) + 0.6) * 200) as v from embeddings cross join range(64) i",
    "big": "select cast(0 as bigint) as image_id, g.y, g.x, coalesce(c.v, 0.0) as v from (select cast(range // 64 as integer) as y, cast(range % 64 as integer) as x from range(4096)) g left join (select cast(l_partkey % 64 as integer) as y, cast(l_orderkey % 64 as integer) as x, cast(cast(floor(sum(l_quantity)) as bigint) % 256 as double) as v from lineitem group by 1, 2) c on c.y = g.y and c.x = g.x",
    "col": "select image_id // 3 as image_id, y, x, max(case when image_id % 3 = 0 then v end) as c1, max(case when image_id % 3 = 1 then v end) as c2, max(case when image_id % 3 = 2 then v end) as c3 from {px} group by 1, 2, 3 having c1 is not null and c2 is not null and c3 is not null",
    "bin": "select image_id, y, x, case when v > 130.0 then 255.0 else 0.0 end as v from {px}",
    "bigbin": "select image_id, y, x, case when v > 130.0 then 255.0 else 0.0 end as v from {big}",
    "vec": "select vec_id, cast(i.range as integer) as p, cast(embedding[i.range + 1] as double) as v from embeddings cross join range(64) i",
}
XYV = ["image_id", "y", "x", "v"]
XYC = ["image_id", "y", "x", "c1", "c2", "c3"]


def frame(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The relation for Spark."""
    if name == "px":
        return B.to_pixels(I.vector_images(spark, d))
    if name == "big":
        return I.grid_image(spark, d)
    if name == "col":
        return I.colour_pixels(frame(spark, d, "px"))
    if name in ("bin", "bigbin"):
        return frame(spark, d, "px" if name == "bin" else "big").withColumn("v", F.when(F.col("v") > 130, 255.0).otherwise(0.0))
    if name == "vec":
        df = spark.read.parquet(f"{d}/embeddings.parquet")
        return df.select("vec_id", F.posexplode("embedding").alias("p", "v")).withColumn("v", F.col("v").cast("double"))
    return P.run(doubles(RELATIONS[name]), **{n: frame(spark, d, n) for n in set(re.findall(r"\{(\w+)\}", RELATIONS[name])) if not n.isdigit()})


def sql_query(text: str, columns: list[str], **names: str) -> Query:
    """The same SQL in both engines. names: what stands for each placeholder: the name of a relation, or
    SQL over relations."""

    def resolve(spark: SparkSession, d: str, body: str) -> DataFrame:
        if body in RELATIONS:
            return frame(spark, d, body)
        inner = {n: resolve(spark, d, names.get(n, n)) for n in set(re.findall(r"\{(\w+)\}", body))}
        return P.run(doubles(body), **inner) if inner else spark.sql(P.numbers(doubles(body), P.SPARK_NUMBERS))

    def run(spark: SparkSession, d: str) -> DataFrame:
        frames = {n: resolve(spark, d, names.get(n, n)) for n in set(re.findall(r"\{(\w+)\}", text))}
        return typed(P.run(doubles(text), **frames), columns)

    bodies = {n: (f"select * from {{{b}}}" if b in RELATIONS else b) for n, b in names.items()}
    return Query(run, oracle(text, columns, **bodies))


def block_query(kernel: Callable, sql: str | None, source: str = "px", columns: list[str] | None = None, **relations: str) -> Query:
    """A kernel over blocks against SQL over relations; relations: further ones, computed once."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        blocks = I.vector_images(spark, d) if source in ("px", "bin") else B.from_pixels(frame(spark, d, "big"))
        if source in ("bin", "bigbin"):
            blocks = blocks.withColumn("data", F.transform("data", lambda v: F.when(v > 130, 255.0).otherwise(0.0)))
        out = B.to_pixels(B.map_blocks(blocks, kernel)).withColumn("v", F.round("v", 4) + 0.0)
        return typed(out, XYV)

    if sql is not None:
        sql = oracle(f"select image_id, y, x, round(v, 4) + 0.0 as v from ({sql}) k_", columns or XYV, **relations)
    return Query(run, sql)
