"""The batch pipeline: chunks, events, checks, filter, entities, timelines, graph; each stage's table can be kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import answer, disambiguation_text, numbered
from ..operators import chunking, cluster, dedupe, graph, timeline, validate
from ..operators.semantic import embed_distinct, hashing_embedder
from ..schemas import ANSWERS
from ..sources.files import exists, stage_path
from .providers import Provider, Rules, year_events
from .timelines import iterative

STAGES = ("chunk", "event", "validate", "filter", "disambiguate", "timeline", "graph")


def chunks(docs: DataFrame, config: Config) -> DataFrame:
    c = config.chunk
    if c.strategy == "sentence":
        return chunking.by_sentences(docs, most=c.max_sentences, overlap=c.sentence_overlap, least=c.min_chunk_size, largest=c.max_chunk_size)
    cut = chunking.by_chars_at_sentences if c.preserve_sentences else chunking.by_chars
    return cut(docs, size=c.chunk_size, overlap=c.chunk_overlap, least=c.min_chunk_size)


def events(chunk_rows: DataFrame, provider: Provider, rounds: int = 1) -> DataFrame:
    """Events of every chunk. A further round asks again about chunks that had some; exact repeats are dropped. Responses
    that do not parse give none; a missing time type is a point, another one drops the event."""
    found = None
    asked = chunk_rows.withColumn("request_id", F.col("chunk_id"))
    for turn in range(rounds):
        replies = provider.respond(asked).withColumn("a", answer("response", ANSWERS["events"]))
        rows = replies.select("request_id", F.posexplode("a.events").alias("pos", "e")).withColumn("turn", F.lit(turn))
        found = rows if found is None else found.unionByName(rows)
        if turn + 1 < rounds:
            asked = asked.join(rows.select("request_id").distinct(), "request_id", "left_semi")
    e = found.join(chunk_rows.select(F.col("chunk_id").alias("request_id"), "doc_id", "doc_title", "chunk_index"), "request_id")
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    e = e.select(F.col("request_id").alias("chunk_id"), "doc_id", "doc_title", "chunk_index", "turn", "pos", text("original_sentence").alias("original_sentence"), text("event_description").alias("event_description"), F.coalesce("e.entities", F.array().cast("array<struct<name:string,canonical_name:string,description:string>>")).alias("entities"), F.coalesce("e.time_type", F.lit("point")).alias("time_type"), F.col("e.time_start").alias("time_start"), F.col("e.time_end").alias("time_end"), text("time_expression").alias("time_expression"))
    e = e.where(F.col("time_type").isin("point", "range")).withColumn("ord", (F.col("turn") * 1_000_000 + F.col("pos")).cast("long"))
    e = dedupe.exact(e)
    number = F.row_number().over(Window.partitionBy("chunk_id").orderBy("ord"))
    e = e.withColumn("event_id", numbered("chunk_id", "event", number.cast("int")))
    canonical = F.transform("entities", lambda x: F.struct(x["name"].alias("name"), F.coalesce(F.nullif(x["canonical_name"], F.lit("")), x["name"]).alias("canonical_name"), F.coalesce(x["description"], F.lit("")).alias("description")))
    return e.withColumn("entities", canonical).withColumn("confidence", F.lit(1.0)).withColumn("ord", F.xxhash64("event_id")).drop("turn", "pos")


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """ord as a number that rises with the columns; a range sort, no single task."""
    return df.drop("ord").orderBy(*by).withColumn("ord", F.monotonically_increasing_id())


def entities(event_rows: DataFrame, config: Config, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Mentions with cluster ids. Blocks are first letters of canonical names: mentions of one entity begin alike."""
    m = event_rows.select("event_id", F.col("ord").alias("e"), F.posexplode("entities").alias("p", "x")).select("event_id", "e", "p", "x.*")
    m = m.withColumn("ord", (F.dense_rank().over(Window.partitionBy(F.lower(F.substring("canonical_name", 1, 1))).orderBy("e", "p"))).cast("long")).withColumn("mention_id", F.concat_ws("#", "event_id", "p"))
    m = m.withColumn("block", F.lower(F.substring("canonical_name", 1, 1))).withColumn("_text", disambiguation_text("canonical_name", "description", config.disambiguator.canonical_name_weight))
    m = embed_distinct(m, "_text", embed or hashing_embedder())
    return cluster.clusters(m.drop("_text", "e", "p"), least=config.disambiguator.similarity_threshold, block=["block"])


def timelines(event_rows: DataFrame, least: int = 2) -> DataFrame:
    """Without a model: an entity's events in the order of time are its timeline, if there are two or more."""
    by = timeline.by_entity(event_rows)
    item = F.struct(F.coalesce("time_start", F.lit("")).alias("t"), "ord", "event_id")
    rows = by.groupBy("entity").agg(F.sort_array(F.collect_list(item)).alias("i"), F.min("ord").alias("entity_ord")).where(F.size("i") >= least)
    lines = rows.select(F.col("entity").alias("entity_canonical_name"), "entity_ord", F.lit(0).alias("position"), F.concat(F.col("entity"), F.lit(" timeline")).alias("timeline_name"), F.lit("").alias("description"), F.transform("i", lambda x: x["event_id"]).alias("event_ids"))
    return timeline.with_spans(timeline.numbered_timelines(lines), event_rows).withColumn("ord", F.col("entity_ord"))


class Pipeline:
    """Runs the stages from `start` to `end`; a stage before `start` is read from where it was written."""

    def __init__(self, spark: SparkSession, config: Config | None = None, *, split: str = "test", provider: Provider | None = None, embed: Callable[[Column], Column] | None = None, timeline_provider: Provider | None = None):
        self.spark, self.config, self.split = spark, config or Config(), split
        self.provider, self.embed, self.timeline_provider = provider or Rules(year_events()), embed, timeline_provider

    def path(self, stage: str) -> str:
        return stage_path(self.config.data_dir, stage, self.split)

    def _kept(self, stage: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(stage))
        return self.spark.read.parquet(self.path(stage))

    def _input(self, *stages: str) -> DataFrame:
        for s in stages:
            if exists(self.spark, self.path(s)):
                return self.spark.read.parquet(self.path(s))
        raise FileNotFoundError(f"none of {', '.join(stages)} has been written under {self.config.data_dir}")

    def run(self, docs: DataFrame | None = None, start: str = "chunk", end: str = "graph") -> dict[str, DataFrame]:
        lo, hi = STAGES.index(start), STAGES.index(end)
        out: dict[str, DataFrame] = {}
        for stage in STAGES[lo : hi + 1]:
            out |= getattr(self, f"_{stage}")(docs)
        return out

    def _chunk(self, docs):
        return {"chunk": self._kept("chunk", chunks(docs, self.config))}

    def _event(self, _):
        x = self.config.extractor
        found = events(self._input("chunk"), self.provider, x.max_rounds if x.enable_multi_round else 1)
        return {"event": self._kept("event", in_order(found, "doc_id", "chunk_index", "event_id"))}

    def _validate(self, _):
        rows = self._input("event")
        return {"validate": self._kept("validate", validate.validate(rows) if self.config.event_validator_enabled else rows)}

    def _filter(self, _):
        rows = self._input("validate", "event")
        return {"filter": self._kept("filter", dedupe.overlapping(rows) if self.config.event_filter_enabled else rows)}

    def _disambiguate(self, _):
        labelled = self._kept("mentions", entities(self._input("filter", "validate", "event"), self.config, self.embed))
        return {"mentions": labelled, "disambiguate": self._kept("disambiguate", cluster.summarise(labelled))}

    def _timeline(self, _):
        rows = self._input("filter", "validate", "event")
        if self.timeline_provider is None:
            return {"timeline": self._kept("timeline", timelines(rows))}
        lines, alone = iterative(timeline.by_entity(rows), self.timeline_provider)
        lines = lines.withColumnRenamed("entity", "entity_canonical_name").withColumn("ord", F.xxhash64("entity_canonical_name", "timeline_id"))
        lines = lines.withColumn("timeline_id", F.concat_ws("/", "entity_canonical_name", "timeline_id"))
        return {"timeline": self._kept("timeline", lines), "standalone": self._kept("standalone", alone)}

    def _graph(self, _):
        g = graph.build(self._input("filter", "validate", "event"), self._input("disambiguate"), self._input("timeline"))
        return {f"graph_{k}": self._kept(f"graph_{k}", v) for k, v in vars(g).items()}
