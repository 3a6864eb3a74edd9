"""Connected components by alternating large and small stars, as DataFrame joins.

Each round's edges are written to the shared folder, so lineage stays short and a lost executor costs
no more than its tasks. Rounds are logarithmic in the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import stage_table


def _state(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) to (node, component): the smallest node that can be reached. Loops, repeated edges
    and either direction are fine; edges with a null end link nothing. No edges, no rows."""
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stage_table(e.distinct(), "component-edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = stage_table(small.distinct(), "component-edges")
        after = _state(e)
        if after == before:
            break
        before = after
    # a star: every node of a component but the least is linked to the least
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
