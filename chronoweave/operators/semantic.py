"""Vector search over a table of nodes (node_id, ord, embedding)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import tokens
from .ranking import threshold, top_k


def hashing_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: token hashes counted with signs, then normalised. JVM only."""

    def embed(text: Column) -> Column:
        hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
        slot = lambda k: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(dims)) == k), F.lit(0.0), lambda s, h: s + F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0))
        return F.transform(V.normalised(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), slot)), lambda x: x.cast("float"))

    return embed


def model_embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column], Column]:
    """A model behind an Arrow function; encode gets lists of `batch` texts."""

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list = []
            for k in range(0, len(texts), batch):
                out += list(encode(list(texts[k : k + batch].fillna(""))))
            yield pd.Series(out)

    return embed


def embed_distinct(df: DataFrame, text: str, embed: Callable[[Column], Column], out: str = "embedding") -> DataFrame:
    """Each distinct text is embedded once."""
    done = df.select(text).distinct().withColumn(out, embed(F.col(text)))
    return df.join(done, text, "left")


def flat_search(nodes: DataFrame, query: Column | list[float], k: int = 10, *, metric: str = "cosine", least: float | None = None) -> DataFrame:
    """Exact: node_id, ord, score of the k best, then those of `least` or more. cosine, ip, or l2 as 1 / (1 + distance)."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    best = top_k(nodes.select("node_id", "ord", V.METRICS[metric](F.col("embedding"), q).alias("score")), k)
    return best if least is None else threshold(best, least)


class IvfIndex:
    """Approximate: vectors by their nearest of sqrt(n) centres (100 at most); a query looks into its nearest `probe`."""

    def __init__(self, nodes: DataFrame, *, lists: int | None = None, probe: int | None = None, seed: int = 1):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = nodes.count()
        self.lists = lists or max(1, min(int(n**0.5), 100))
        self.probe = probe or min(self.lists, 10)
        ready = nodes.withColumn("features", array_to_vector(V.normalised("embedding")))
        self.model = KMeans(k=self.lists, seed=seed, maxIter=10, predictionCol="list").fit(ready)
        self.rows = self.model.transform(ready).drop("features")

    def search(self, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        near = sorted(range(len(self.model.clusterCenters())), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.model.clusterCenters()[i], _unit(query), strict=True)))[: self.probe]
        return flat_search(self.rows.where(F.col("list").isin(near)), query, k, metric=metric)


def _unit(v: list[float]) -> list[float]:
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]


def similar_pairs(nodes: DataFrame, least: float, *, blocks: list[str] | None = None) -> DataFrame:
    """Pairs a < b (by ord) whose cosine is `least` or more. blocks: columns that both must share; without them every
    pair is compared, which suits entity tables of thousands of rows, not millions."""
    unit = nodes.select("node_id", "ord", V.normalised("embedding").alias("u"), *(blocks or []))
    a, b = unit.alias("a"), unit.alias("b")
    on = F.col("a.ord") < F.col("b.ord")
    for c in blocks or []:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).select(F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), V.dot(F.col("a.u"), F.col("b.u")).alias("similarity")).where(F.col("similarity") >= least)


def save_vectors(nodes: DataFrame, path: str, metric: str = "cosine") -> None:
    """The metric is kept with the vectors."""
    nodes.withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
