"""Rank, fuse and deduplicate scored rows. Every order ends in a tiebreak, so results don't depend on the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank. A filter on row_number lets Spark keep k rows for each group before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keep_best(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_at = 1").drop("_at")


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int, by: list[str], constant: int = 60) -> DataFrame:
    """Sum of weight / (constant + rank) over ranked lists (by, id, rank)."""
    parts = [d.select(*by, "id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for d, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy(*by, "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(fused, k, by)


def linear_fusion(lists: list[tuple[DataFrame, float]], k: int, by: list[str]) -> DataFrame:
    """Sum of weighted scores, each list scaled to 0..1 for each query; a constant list counts 0."""
    group = Window.partitionBy(*by)
    parts = []
    for d, w in lists:
        low, span = F.min("score").over(group), F.max("score").over(group) - F.min("score").over(group)
        parts.append(d.select(*by, "id", (w * F.when(span > 0, (F.col("score") - low) / span).otherwise(0.0)).alias("part")))
    fused = reduce(DataFrame.unionByName, parts).groupBy(*by, "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(fused, k, by)


def union_best(lists: list[DataFrame], k: int, by: list[str]) -> DataFrame:
    """Set union: an id keeps its best score."""
    best = reduce(DataFrame.unionByName, [d.select(*by, "id", "score") for d in lists]).groupBy(*by, "id").agg(F.max("score").alias("score"))
    return top(best, k, by)


def merged_variants(lists: list[DataFrame], k: int, by: list[str]) -> DataFrame:
    """The k best of the candidates (by, id, fused, utility, similarity) that several variants of a query found: an id stands as its best fused score has it, of equal ones the earlier list's; order by fused, utility and similarity."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("_list", F.lit(i)) for i, d in enumerate(lists)])
    best = keep_best(rows, [*by, "id"], F.desc("fused"), F.col("_list")).drop("_list")
    order = Window.partitionBy(*by).orderBy(F.desc("fused"), F.desc("utility"), F.desc("similarity"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def standard_score(value: Column, group, clamp: float = 3.0) -> Column:
    """Population z-score within a window; one row, or no spread, counts as spread 1; cut at the clamp."""
    spread = F.stddev_pop(value).over(group)
    z = (value - F.avg(value).over(group)) / F.when(F.coalesce(spread, F.lit(0.0)) > 1e-9, spread).otherwise(1.0)
    return F.greatest(F.least(z, F.lit(clamp)), F.lit(-clamp))
