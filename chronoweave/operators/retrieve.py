"""Retrieval over a graph: keyword, semantic, hybrid, voting, hierarchical, and several queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import embed_text
from . import keyword, provenance, semantic, voting
from . import ranking as R
from .graph import Graph, entity_context, name_matches

LAYERS = ("entity", "event", "timeline")
_KEYS = {"entity": "name", "event": "event_id", "timeline": "timeline_id"}
_TEXTS = {
    "entity": ("name", "description", "aliases"),
    "event": ("event_description", "time_expression", "original_sentence", "entity_names"),
    "timeline": ("timeline_name", "description", "entity_canonical_name"),
}
_EMBED = {"entity": ("name", "description", "aliases"), "event": ("event_description", "original_sentence"), "timeline": ("entity_canonical_name", "timeline_name", "description")}


@dataclass
class Retriever:
    graph: Graph
    config: Config = field(default_factory=Config)
    embed: Callable[[Column], Column] | None = None
    _kept: dict = field(default_factory=dict)

    def table(self, layer: str) -> DataFrame:
        return {"entity": self.graph.entities, "event": self.graph.events, "timeline": self.graph.timelines}[layer]

    def nodes(self, layer: str) -> DataFrame:
        """node_id, ord, text, embedding; kept while the retriever lives."""
        if layer not in self._kept:
            df = self.table(layer)
            part = lambda c: F.array_join(F.col(c), " ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")
            have = lambda names: [part(c) for c in names if c in df.columns] or [F.col(_KEYS[layer]).cast("string")]
            embed = self.embed or semantic.hashing_embedder()
            rows = df.select(F.col(_KEYS[layer]).cast("string").alias("node_id"), "ord", F.concat_ws(" ", *have(_TEXTS[layer])).alias("text"), embed_text(*have(_EMBED[layer])).alias("_e"))
            self._kept[layer] = rows.withColumn("embedding", embed(F.col("_e"))).drop("_e").cache()
        return self._kept[layer]

    def invalidate(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def keyword(self, query: str, k: int, layer: str) -> DataFrame:
        c = self.config.retriever
        options = {"k1": c.bm25_k1, "b": c.bm25_b} if c.keyword_algorithm == "bm25" else {}
        return R.with_rank(R.top_k(keyword.search(self.nodes(layer), query, algorithm=c.keyword_algorithm, **options), k))

    def semantic(self, query: str, k: int, layer: str, least: float | None = None) -> DataFrame:
        embed = self.embed or semantic.hashing_embedder()
        n = self.nodes(layer)
        q = n.sparkSession.range(1).select(embed(F.lit(query)).alias("q"))
        return R.with_rank(semantic.flat_search(n.crossJoin(F.broadcast(q)), F.col("q"), k, metric=self.config.retriever.vector_metric, least=least))

    def hybrid(self, query: str, k: int, layer: str, mode: str | None = None) -> DataFrame:
        """node_id, ord, score, rank: both rankings at 2 k, fused; a single one if the other is off."""
        c = self.config.retriever
        if not (c.enable_keyword or c.enable_semantic):
            raise ValueError("keyword and semantic search are both off")
        if not c.enable_semantic:
            return self.keyword(query, k, layer)
        if not c.enable_keyword:
            return self.semantic(query, k, layer)
        fused = R.fuse(self.keyword(query, 2 * k, layer), self.semantic(query, 2 * k, layer), mode or c.fusion_mode, rrf_k=c.rrf_k, keyword_weight=c.keyword_weight, semantic_weight=c.semantic_weight)
        return R.with_rank(R.top_k(fused.join(self.nodes(layer).select("node_id", "ord"), "node_id"), k))

    def search(self, query: str, k: int | None = None, target: str = "all", mode: str = "hybrid", fusion: str | None = None) -> DataFrame:
        """The k best of one layer, or of all (scores are compared as they are): node_type, node_id, score."""
        k = k or self.config.retriever.top_k
        how = {"hybrid": lambda lay: self.hybrid(query, k, lay, fusion), "keyword": lambda lay: self.keyword(query, k, lay), "semantic": lambda lay: self.semantic(query, k, lay, self.config.retriever.similarity_threshold)}[mode]
        out = None
        for n, layer in enumerate(LAYERS if target == "all" else (target,)):
            rows = how(layer).select(F.lit(layer).alias("node_type"), "node_id", "score", F.struct(F.lit(n).alias("l"), F.col("rank").alias("r")).alias("ord"))
            out = rows if out is None else out.unionByName(rows)
        return R.top_k(out, k).drop("ord")

    def _edges(self) -> tuple[DataFrame, DataFrame]:
        text = lambda df, *cols: df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        return text(self.graph.participates, "name", "event_id"), text(self.graph.belongs, "timeline_id", "event_id")

    def vote(self, query: str, k: int | None = None, mode: str | None = None, details: bool = False) -> DataFrame:
        k, c = k or self.config.retriever.top_k, self.config.voting
        hits = {lay: self.hybrid(query, int(k * c.multiplier), lay) for lay in LAYERS}
        votes = voting.collect_votes(hits["entity"], hits["timeline"], hits["event"], *self._edges(), entity_decay=c.entity_decay, timeline_decay=c.timeline_decay)
        events = self.graph.events.withColumn("event_id", F.col("event_id").cast("string"))
        extra = {"alpha": c.alpha, "beta": c.beta, "rrf_k": c.rrf_k, "weights": {"entity": c.entity_weight, "timeline": c.timeline_weight, "event": c.event_weight}}
        return voting.elect(votes, events, k, mode or c.fusion_mode, min_votes=c.min_votes, min_score=c.min_score, details=details, **extra)

    def hierarchical(self, query: str, k1: int | None = None, k2: int | None = None, k3: int | None = None) -> dict[str, DataFrame]:
        """entities, then their timelines and events rescored, with the entities that each comes from."""
        c = self.config.hierarchical
        k1, k2, k3 = k1 or c.k1, k2 or c.k2, k3 or c.k3
        ents = R.threshold(self.hybrid(query, k1, "entity"), c.entity_threshold).withColumnRenamed("node_id", "name")
        out = {"entities": ents}
        for layer, edges, key, k, least in (("timeline", self.graph.has, "timeline_id", k2, c.timeline_threshold), ("event", self.graph.participates, "event_id", k3, c.event_threshold)):
            e = edges.select("name", F.col(key).cast("string").alias(key), "ord")
            cands = voting.related(ents, e, key)
            every = self.hybrid(query, max(1, self.table(layer).count()), layer)
            out[f"{layer}s"] = voting.provenance(voting.rescore(cands, every, key, k, least=least), e, ents, key)
        return out

    def in_entity(self, query: str, name: str, k: int | None = None) -> DataFrame:
        """Events of one entity (by exact name, else by part of it) by the share of the query's words in their texts."""
        ents = self.graph.entities.where(name_matches(F.col("name"), F.col("aliases"), name, False))
        if not ents.limit(1).count():
            ents = self.graph.entities.where(name_matches(F.col("name"), F.col("aliases"), name, True))
        ids = self.graph.entity_events(ents).select(F.col("event_id").cast("string").alias("node_id")).distinct()
        return R.top_k(entity_context(self.nodes("event").join(ids, "node_id"), F.col("text"), query), k or self.config.retriever.top_k)

    def chunks(self, query: str, chunks: DataFrame, k: int = 5, before: int = 0, after: int = 0) -> DataFrame:
        """The chunks that the k best events were read in, each once; with before or after also those around them."""
        hits = self.search(query, k, "event").select("node_id")
        events = self.graph.events.join(hits, F.col("event_id").cast("string") == F.col("node_id"), "left_semi")
        if before or after:
            return provenance.surrounding_events(events, chunks, before, after)
        return provenance.event_chunks(events, chunks, distinct=True)

    def many(self, queries: dict, *, entity_k: int = 5, timeline_k: int = 10, event_k: int = 20, mode: str = "hybrid") -> dict[str, DataFrame]:
        """queries: entity_query, timeline_query, event_queries. Events of several queries in their order, each once; then
        the events of the timelines found."""
        events = None
        for n, q in enumerate(queries["event_queries"]):
            hits = self.search(q, event_k, "event", mode)
            ranked = R.with_rank(hits.withColumn("ord", F.col("node_id"))).select(F.col("node_id").alias("event_id"), "score", F.struct(F.lit(n).alias("q"), F.col("rank").alias("r")).alias("place"))
            events = ranked if events is None else events.unionByName(ranked)
        first = R.first_wins(events, ["event_id"], [F.col("place")]).orderBy("place").limit(event_k)
        first = R.with_rank(first.withColumn("o", F.col("place")).withColumn("zero", F.lit(0.0)), score="zero", order="o").select("event_id", "score", "rank")
        lines = R.with_rank(self.search(queries["timeline_query"], timeline_k, "timeline", mode).withColumn("ord", F.col("node_id"))).select(F.col("node_id").alias("timeline_id"), "rank")
        belongs = self.graph.belongs.select(F.col("timeline_id").cast("string").alias("timeline_id"), F.col("event_id").cast("string").alias("event_id"), "position")
        return {"entities": self.search(queries["entity_query"], entity_k, "entity", mode), "timelines": lines, "events": first, "merged": provenance.expand_timelines(first, lines, belongs)}
