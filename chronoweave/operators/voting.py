"""Events elected by entities, timelines and themselves; and entity by entity, layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

LAYER_WEIGHTS = {"entity": 0.25, "timeline": 0.30, "event": 0.45}


def collect_votes(entities: DataFrame, timelines: DataFrame, events: DataFrame, participates: DataFrame, belongs: DataFrame, *, entity_decay: float = 0.7, timeline_decay: float = 0.9) -> DataFrame:
    """Ranked hits of three layers (node_id, score, rank from 0) to votes (event_id, layer, source_id, source_score,
    weight, rank): an entity votes once for each of its edges, a timeline for each of its events, an event for itself."""
    cols = ("event_id", "layer", "source_id", "source_score", "weight", "rank")

    def cast(hits: DataFrame, layer: str, decay: float) -> DataFrame:
        return hits.select("event_id", F.lit(layer).alias("layer"), F.col("node_id").cast("string").alias("source_id"), F.col("score").alias("source_score"), (F.col("score") * decay).alias("weight"), "rank").select(*cols)

    by_entity = entities.join(participates.select(F.col("name").alias("node_id"), "event_id"), "node_id")
    by_timeline = timelines.join(belongs.select(F.col("timeline_id").alias("node_id"), "event_id"), "node_id")
    return cast(by_entity, "entity", entity_decay).unionByName(cast(by_timeline, "timeline", timeline_decay)).unionByName(cast(events.withColumn("event_id", F.col("node_id")), "event", 1.0))


def layer_weight(weights: dict[str, float] | None = None):
    out = F.lit(1.0)
    for layer, w in (weights or LAYER_WEIGHTS).items():
        out = F.when(F.col("layer") == layer, w).otherwise(out)
    return out


def aggregate(votes: DataFrame, mode: str = "rrf", *, weights: dict[str, float] | None = None, rrf_k: int = 60, alpha: float = 0.3, beta: float = 0.7) -> DataFrame:
    """event_id, vote_count, score. rrf: sum of w / (k + rank + 1). weighted: sum of w times the vote. vote_count: alpha
    times min(n / 10, 1) plus beta times the mean vote. borda: sum of w times (largest rank cast in the layer + 1 -
    rank)."""
    w = layer_weight(weights)
    n = F.count(F.lit(1)).alias("vote_count")
    if mode == "weighted":
        return votes.groupBy("event_id").agg(n, F.sum(w * F.col("weight")).alias("score"))
    if mode == "vote_count":
        return votes.groupBy("event_id").agg(n, (F.least(F.count(F.lit(1)) / 10.0, F.lit(1.0)) * alpha + F.avg("weight") * beta).alias("score"))
    if mode == "borda":
        # three rows: joined, where a window would gather a layer's votes in one task
        most = votes.groupBy("layer").agg(F.max("rank").alias("most"))
        return votes.join(F.broadcast(most), "layer").groupBy("event_id").agg(n, F.sum(w * (F.col("most") + 1 - F.col("rank"))).alias("score"))
    return votes.groupBy("event_id").agg(n, F.sum(w / (F.lit(float(rrf_k)) + F.col("rank") + 1)).alias("score"))


def elect(votes: DataFrame, events: DataFrame, k: int = 10, mode: str = "rrf", *, min_votes: int = 1, min_score: float = 0.0, details: bool = False, **options) -> DataFrame:
    """The k events of the best scores, of those that the graph has; details: with their votes."""
    scored = aggregate(votes, mode, **options).where((F.col("vote_count") >= min_votes) & (F.col("score") >= min_score))
    best = top_k(scored.join(events, "event_id"), k)
    if not details:
        return best
    cast = votes.join(best.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("layer", "rank", "source_id", "source_score", "weight"))).alias("votes"))
    return best.join(cast, "event_id", "left")


# Hierarchical retrieval


def related(entities: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes of the retrieved entities (name, rank), once each, in the order of entities and edges."""
    met = entities.select("name", "rank").join(edges, "name")
    return met.groupBy(key).agg(F.min(F.struct("rank", "ord")).alias("seen"))


def rescore(candidates: DataFrame, ranked: DataFrame, key: str, k: int, *, least: float = 0.0) -> DataFrame:
    """Candidates with their score in a ranking of all nodes (node_id, score, rank), of which as many count as there are
    candidates; those below `least` or beyond score 0; the k best, ties by the order in which candidates were seen."""
    n = candidates.agg(F.count(F.lit(1)).alias("n"))
    counted = ranked.crossJoin(F.broadcast(n)).where((F.col("rank") < F.col("n")) & (F.col("score") >= least)).select(F.col("node_id").alias(key), "score")
    scored = candidates.join(counted, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    # scored rows come before padded ones of equal score
    return scored.orderBy(F.col("score").desc(), "seen", key).limit(k)


def provenance(rows: DataFrame, edges: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Adds the retrieved entities (name, score, rank) that a row comes from: names and scores, in edge order."""
    via = edges.join(entities.select("name", F.col("score").alias("entity_score")), "name")
    named = via.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("ord", "name", "entity_score"))).alias("v"))
    return rows.join(named, key, "left").withColumn("source_entity_names", F.transform("v", lambda x: x["name"])).withColumn("source_entity_scores", F.transform("v", lambda x: x["entity_score"])).drop("v")
