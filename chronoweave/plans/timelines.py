"""Timelines by a provider: one request an entity, or batch by batch with what the batches before have said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer
from ..operators import timeline
from ..schemas import ANSWERS
from .providers import Provider


def _listed(events: DataFrame) -> DataFrame:
    """A row per entity and batch: its events in the order of ord, as ids and as JSON for a prompt."""
    item = F.struct("ord", F.col("event_id").cast("string").alias("event_id"), "event_description", "time_start", "time_end")
    rows = events.groupBy("entity", "batch").agg(F.sort_array(F.collect_list(item)).alias("i"), F.min("ord").alias("entity_ord"))
    return rows.select("entity", "batch", "entity_ord", F.transform("i", lambda x: x["event_id"]).alias("event_ids"), F.to_json("i").alias("events"))


def single_shot(events: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """events (entity, event_id, ord, event_description, time_start, time_end): timelines with spans, and standalone events.
    An entity of one event is not asked about; events that the answer leaves out stay unassigned."""
    grouped = _listed(events.withColumn("batch", F.lit(0)))
    asked = grouped.where(F.size("event_ids") > 1).withColumn("request_id", F.col("entity")).withColumn("prompt", F.col("events"))
    replies = provider.respond(asked).select(F.col("request_id").alias("entity"), "response")
    lines, alone = timeline.from_answers(grouped, replies)
    return timeline.with_spans(lines, events), alone


def iterative(events: DataFrame, provider: Provider, *, size: int = 20, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities of more than `size` events are asked about batch by batch (their events in the order of time): the first
    request has the batch's events alone, later ones (prompt: JSON with events and timelines) also the timelines so far,
    `most` of them. An answer may go on with a timeline by its id or begin one; one that does not parse skips its batch.
    Entities of fewer events are asked once. Returns timelines (entity, timeline_id, timeline_name, description,
    event_ids, spans) and standalone events less those that a timeline took later. Requests of one round go to the
    provider together, so the rounds are as many as the largest entity has batches; each round is checkpointed where the
    session has a checkpoint folder."""
    spark = events.sparkSession
    kept = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    batches = kept(_listed(timeline.batches(events, size)))
    single = batches.where(F.col("batch") == 0).where(F.size("event_ids") == 1).join(batches.where("batch > 0").select("entity").distinct(), "entity", "left_anti")
    rounds = (batches.agg(F.max("batch")).first()[0] or 0) + 1
    parts = alone = None
    for b in range(rounds):
        here = batches.where(F.col("batch") == b).join(single.select("entity"), "entity", "left_anti")
        if parts is not None:
            so_far = timeline.merge_batches(parts, events)
            here = here.join(timeline.timelines_prompt(so_far, most).withColumnRenamed("prompt", "known"), "entity", "left")
        else:
            here = here.withColumn("known", F.lit(None).cast("string"))
        prompt = F.to_json(F.struct(F.col("events"), F.col("known").alias("timelines")))
        asked = here.withColumn("request_id", F.col("entity")).withColumn("prompt", prompt)
        told = provider.respond(asked).select(F.col("request_id").alias("entity"), answer("response", ANSWERS["timelines"]).alias("a"))
        told = kept(told.where("a is not null").withColumn("batch", F.lit(b)))
        each = told.select("entity", "batch", F.posexplode("a.timelines").alias("place", "t"))
        named = F.coalesce(F.nullif(F.col("t.timeline_id"), F.lit("")), F.format_string("batch-%d-%d", "batch", "place"))
        new = each.select("entity", "batch", named.alias("timeline_id"), "t.timeline_name", "t.description", "t.event_ids")
        left = told.select("entity", F.explode("a.standalone_events").alias("s")).select("entity", "s.event_id", "s.reason")
        parts = new if parts is None else parts.unionByName(new)
        alone = left if alone is None else alone.unionByName(left)
    merged = timeline.merge_batches(parts, events)
    lonely = single.select("entity", F.explode("event_ids").alias("event_id"), F.lit("Single event, no timeline needed").alias("reason"))
    return merged, lonely.unionByName(timeline.standalone(alone, merged))
