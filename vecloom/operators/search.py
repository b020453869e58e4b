"""Exact and cluster-pruned top-k cosine search, and measures of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import cosine_to


def top_k(rows: DataFrame, query: Sequence[float], k: int = 10, mismatch: str = "search", tie: str = "content_hash", column: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine, ties by `tie`; vectors of other widths are skipped. Each task keeps k rows."""
    scored = rows.withColumn("similarity", cosine_to(F.col(column), query, mismatch))
    if mismatch == "search":
        scored = scored.filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.col("similarity").desc_nulls_last(), F.col(tie)).limit(k)


def probe(clustered: DataFrame, clusters: Sequence[int], query: Sequence[float], k: int = 10) -> DataFrame:
    """top_k over some clusters; their ids are literals, which prune partitions where a subquery would not."""
    return top_k(clustered.filter(F.col("cluster_id").isin([int(c) for c in clusters])), query, k, "zero")


def recall(found: DataFrame, exact: DataFrame, key: str = "content_hash") -> DataFrame:
    """hits, wanted, recall of a search against the exact one (a few rows each)."""
    hits = exact.select(key).distinct().join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hits.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("wanted")).select("hits", "wanted", F.coalesce(F.try_divide("hits", "wanted"), F.lit(0.0)).alias("recall"))


def ndcg_at(ranked: DataFrame, k: int, query: str = "query_id", rank: str = "rank", gain: str = "gain") -> DataFrame:
    """query, ndcg: normalised discounted cumulative gain of the first k (rank from 1); 0 where no gain is positive."""
    def total(place: str):
        return F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col(place) + 1)).otherwise(0.0))

    ideal = ranked.withColumn("__best", F.row_number().over(Window.partitionBy(query).orderBy(F.col(gain).desc())))
    return ideal.groupBy(query).agg(F.coalesce(F.try_divide(total(rank), total("__best")), F.lit(0.0)).alias("ndcg"))


def nearest_ranks(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """share, value: the value at place round(share * (n - 1)), half to even, of the values in order; nulls are left out.

    Values are counted first, so that what is put in order is one row a distinct value.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    n = counts.agg(F.sum("n").alias("all"))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.bround(F.lit(float(s)) * (F.col("all") - 1)).cast("long").alias("place")) for s in shares)))
    places = n.filter("all is not null").select(wanted.alias("w")).select("w.*")
    return places.join(upto, (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).select("share", "value")
