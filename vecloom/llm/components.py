"""Connected components of an edge table, without any vertex set on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import materialize


def components(edges: DataFrame) -> DataFrame:
    """v, root (the smallest vertex reachable) for every vertex of edges (a, b), both long.

    Alternating star contraction: each round hangs the larger neighbours of a vertex, then the smaller ones, on its
    smallest neighbour, until every vertex points at its root. Rounds grow with the logarithm of the longest path; each
    round's edges are written to the shared folder, so that lost executors never replay earlier rounds. Hubs are joined
    by ordinary shuffled joins, whose hot partitions Spark splits. Nulls and loops are dropped; an empty table gives none.
    """
    now = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        now = materialize(small, "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if mark == before or not mark[0]:
            break
        before = mark
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v").alias("root")).distinct())
