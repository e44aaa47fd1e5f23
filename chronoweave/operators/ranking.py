"""Ranked results: thresholds, top-k, and the fusion of several rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int = 10, score: str = "score", order: str = "ord") -> DataFrame:
    """The k best, ties by `order`; one pass with a bounded heap per partition."""
    return df.orderBy(F.col(score).desc(), order).limit(k)


def with_rank(df: DataFrame, score: str = "score", order: str = "ord", within: list[str] | None = None) -> DataFrame:
    """Adds rank, from 0, in each group or in all; meant for results that top_k has made few."""
    by = Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.col(score).desc(), order)
    return df.withColumn("rank", F.row_number().over(by) - 1)


def top_k_within(df: DataFrame, within: list[str], k: int, score: str = "score", order: str = "ord") -> DataFrame:
    return with_rank(df, score, order, within).where(F.col("rank") < k)


def threshold(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= least)


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(by)).where("_first = 1").drop("_first")


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return first_wins(df, key, [F.col(order).desc()])


def fuse(keyword: DataFrame, semantic: DataFrame, mode: str = "rrf", *, key: str = "node_id", rrf_k: int = 60, keyword_weight: float = 0.3, semantic_weight: float = 0.7) -> DataFrame:
    """Two ranked results (key, score, rank from 0) into one (key, score).

    rrf: sum of 1 / (k + rank + 1). weighted_sum: sum of w s over the sum of w of the rankings that have the row.
    max_score: the larger score. interleave: by turns, keyword first; the score falls from 1 in equal steps. Any other
    mode counts as rrf."""
    both = keyword.select(key, "score", "rank", F.lit(0).alias("src"), F.lit(keyword_weight).alias("w")).unionByName(semantic.select(key, "score", "rank", F.lit(1).alias("src"), F.lit(semantic_weight).alias("w")))
    if mode == "weighted_sum":
        return both.groupBy(key).agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"))
    if mode == "max_score":
        return both.groupBy(key).agg(F.max("score").alias("score"))
    if mode == "interleave":
        first = both.groupBy(key).agg(F.min(F.struct("rank", "src")).alias("turn"))
        order = Window.partitionBy(F.lit(0)).orderBy("turn")
        return first.select(key, (1 - (F.row_number().over(order) - 1) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).alias("score"))
    return both.groupBy(key).agg(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank") + 1)).alias("score"))


def fuse_with_payload(keyword: DataFrame, semantic: DataFrame, mode: str = "rrf", *, key: str = "node_id", **options) -> DataFrame:
    """fuse, with the other columns of whichever result scored the row higher (keyword where equal)."""
    both = keyword.unionByName(semantic, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "score", "rank")]
    payload = both.groupBy(key).agg(F.max_by(F.struct(*rest), "score").alias("_p")) if rest else None
    scored = fuse(keyword, semantic, mode, key=key, **options)
    return scored.join(payload, key).select(key, *[f"_p.{c}" for c in rest], "score") if rest else scored
