"""Timelines: events by entity, spans, batches, merging, and the windows of earlier events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer
from ..schemas import ANSWERS


def by_entity(events: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A row per mention: entity, event_id, ...; an event that mentions an entity twice is there twice. targets: a table
    of names to stay with."""
    rows = events.select("*", F.explode("entities").alias("m")).withColumn("entity", F.col("m.canonical_name")).drop("m").where("entity <> ''")
    return rows if targets is None else rows.join(targets.select(F.col("name").alias("entity")), "entity", "left_semi")


def span(start: Column, end: Column) -> tuple[Column, Column]:
    """Aggregates: the least start and the greatest end (or start, where there is none), as texts; blanks do not count."""
    s, e = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    return F.min(s).alias("time_span_start"), F.max(F.coalesce(e, s)).alias("time_span_end")


def with_spans(timelines: DataFrame, events: DataFrame) -> DataFrame:
    """timelines (timeline_id, event_ids, ...) with their spans; unknown ids are passed over."""
    ids = timelines.select("timeline_id", F.explode("event_ids").alias("event_id"))
    spans = ids.join(events.select("event_id", "time_start", "time_end"), "event_id").groupBy("timeline_id").agg(*span(F.col("time_start"), F.col("time_end")))
    return timelines.drop("time_span_start", "time_span_end").join(spans, "timeline_id", "left")


def batches(events: DataFrame, size: int = 20, within: str = "entity") -> DataFrame:
    """Adds batch: an entity's events in the order of their start (none first), cut into groups of `size`."""
    by = Window.partitionBy(within).orderBy(F.coalesce("time_start", F.lit("")), "ord")
    return events.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("int"))


def numbered_timelines(timelines: DataFrame) -> DataFrame:
    """timelines (entity_ord, position, ...) with timeline_id counted on across entities. Each entity's offset is the
    running sum of counts: the window has a row per entity, not per timeline."""
    counts = timelines.groupBy("entity_ord").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("entity_ord").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("entity_ord", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("entity_ord").orderBy("position")) - 1
    return timelines.join(offsets, "entity_ord").withColumn("timeline_id", F.format_string("timeline-%04d", F.col("offset") + place)).drop("offset")


def merge_batches(parts: DataFrame, events: DataFrame) -> DataFrame:
    """parts (entity, batch, timeline_id, timeline_name, description, event_ids): what each batch said of a timeline. Later
    batches append to a timeline that is there; its name and description are the first's. Spans are computed anew."""
    merged = parts.groupBy("entity", "timeline_id").agg(F.min_by("timeline_name", "batch").alias("timeline_name"), F.min_by("description", "batch").alias("description"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("batch", "event_ids"))), lambda x: x["event_ids"])).alias("event_ids"), F.min("batch").alias("first_batch"))
    return with_spans(merged, events)


def standalone(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """Standalone events (entity, event_id, reason) of all batches, less those that a timeline took later."""
    taken = merged.select("entity", F.explode("event_ids").alias("event_id"))
    return parts.join(taken, ["entity", "event_id"], "left_anti")


def from_answers(grouped: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grouped (entity, entity_ord, event_ids) and answers (entity, response): timelines and standalone events. An entity
    of one event has no timeline and is not asked about."""
    single = grouped.where(F.size("event_ids") == 1).select("entity", F.explode("event_ids").alias("event_id"), F.lit("Single event, no timeline needed").alias("reason"))
    asked = grouped.where(F.size("event_ids") > 1).join(answers, "entity").withColumn("a", answer("response", ANSWERS["timelines"]))
    lines = asked.select("entity", "entity_ord", F.posexplode("a.timelines").alias("position", "t")).select("entity", "entity_ord", "position", "t.timeline_name", "t.description", "t.event_ids")
    alone = asked.select("entity", F.explode("a.standalone_events").alias("s")).select("entity", "s.event_id", "s.reason")
    return numbered_timelines(lines), single.unionByName(alone)


# Windows of earlier events, per document in the order of chunks


def prior_events(chunks: DataFrame, mode: str = "none", n: int = 3, *, item: Column | None = None) -> DataFrame:
    """chunks (doc_id, chunk_index, events array) with prior: the events of earlier chunks. none: nothing. full: of all.
    sliding: of the document's first chunk and of the n before."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    events = item if item is not None else F.col("events")
    if mode == "none":
        return chunks.withColumn("prior", F.slice(events, F.lit(1), F.lit(0)))
    if mode == "full":
        return chunks.withColumn("prior", F.flatten(F.collect_list(events).over(w.rangeBetween(Window.unboundedPreceding, -1))))
    recent = F.collect_list(F.when(F.col("chunk_index") >= 1, events)).over(w.rangeBetween(-n, -1))
    first = F.first(F.when(F.col("chunk_index") == 0, events), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    empty = F.slice(events, F.lit(1), F.lit(0))
    return chunks.withColumn("prior", F.concat(F.coalesce(first, empty), F.flatten(recent)))


def rounds(chunks: DataFrame) -> DataFrame:
    """Adds round: the k-th chunks of all documents form round k."""
    return chunks.withColumn("round", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1)


# Prompts


def prior_prompt(events: Column) -> Column:
    """JSON of events for a prompt, each with three entities at most."""
    return F.to_json(F.transform(events, lambda e: F.struct(e["event_id"].alias("event_id"), e["event_description"].alias("description"), F.slice(F.transform(e["entities"], lambda x: x["canonical_name"]), 1, 3).alias("entities"), F.when(e["time_type"] == "range", F.concat_ws(" - ", F.coalesce(e["time_start"], F.lit("?")), F.coalesce(e["time_end"], F.lit("?")))).otherwise(e["time_start"]).alias("time"))))


def timelines_prompt(timelines: DataFrame, most: int = 50) -> DataFrame:
    """entity, prompt: JSON of the first timelines, each with its span and three sample ids."""
    t = timelines.select("entity", "timeline_id", F.struct("timeline_id", "timeline_name", "description", F.concat_ws(" - ", F.coalesce("time_span_start", F.lit("?")), F.coalesce("time_span_end", F.lit("?"))).alias("span"), F.slice("event_ids", 1, 3).alias("samples")).alias("t"))
    return t.groupBy("entity").agg(F.to_json(F.slice(F.sort_array(F.collect_list("t")), 1, most)).alias("prompt"))


