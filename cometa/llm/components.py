"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join, and keeps the number of edges at most
about the same; nothing is collected. A vertex with very many neighbours is a
minimum (combined on the map side) and a join key that Spark may split. Each
round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cometa.llm.common import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b."""
    if large:  # a vertex's larger neighbours go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        made = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:  # a vertex and its smaller neighbours go to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        made = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return made.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex in ``edges`` (a, b); a component is named by its least vertex."""
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "star")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = state(now)
    while before[0]:
        now = save(_star(save(_star(now, True), "star"), False), "star")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
