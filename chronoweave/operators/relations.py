"""Relations: events told as typed relations by a provider, and those that matter for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer
from ..plans.providers import Provider
from ..schemas import ANSWERS

#: Events in one request where events are told in batches.
BATCH = 20


def _rows(replies: DataFrame, ids: Column, text: Column) -> DataFrame:
    """replies (key, a, and what ids and text read) to a row per relation; a missing confidence is 1."""
    each = replies.select("key", ids.alias("source_event_ids"), text.alias("source_description"), F.posexplode("a.relations").alias("i", "r"))
    number = F.concat(F.col("key"), F.lit("-rel-"), F.col("i").cast("string"))
    blank = lambda c: F.nullif(F.col(f"r.{c}"), F.lit("")).alias(c)
    named = [F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in ("relation_type", "subject", "object_entity")]
    return each.select(number.alias("relation_id"), *named, blank("time_start"), blank("time_end"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), "source_event_ids", "source_description")


def structurise(events: DataFrame, provider: Provider) -> DataFrame:
    """events (event_id, event_description, entity_names, ...): one request each, none for events without a description or
    names; relations numbered <event>-rel-<i>. A response that does not parse gives none."""
    asked = events.where((F.trim(F.coalesce("event_description", F.lit(""))) != "") & (F.size("entity_names") > 0))
    asked = asked.withColumn("key", F.col("event_id").cast("string")).withColumn("request_id", F.col("key"))
    replies = provider.respond(asked).select(F.col("request_id").alias("key"), answer("response", ANSWERS["relations"]).alias("a"))
    both = asked.select("key", "event_description").join(replies, "key")
    return _rows(both, F.array("key"), F.col("event_description"))


def structurise_in_batches(events: DataFrame, provider: Provider, *, size: int = BATCH, shards: int = 64) -> DataFrame:
    """The same by requests of `size` events (a column prompt: their descriptions as a JSON list), in the order of ord
    within each of `shards` shares of the events, so that no task numbers all of them."""
    dealt = events.withColumn("shard", F.pmod(F.xxhash64(F.col("event_id").cast("string")), F.lit(shards)))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("ord", "event_id")) - 1
    batch = F.concat_ws("-", F.lit("batch"), "shard", F.floor(place / size))
    item = F.struct("ord", F.col("event_id").cast("string").alias("event_id"), "event_description")
    grouped = dealt.withColumn("key", batch).groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items"))
    asked = grouped.withColumn("prompt", F.to_json(F.transform("items", lambda x: F.struct(x["event_id"].alias("event_id"), x["event_description"].alias("description"))))).withColumn("request_id", F.col("key"))
    replies = provider.respond(asked).select(F.col("request_id").alias("key"), answer("response", ANSWERS["relations"]).alias("a"))
    both = asked.select("key", F.transform("items", lambda x: x["event_id"]).alias("ids")).join(replies, "key")
    return _rows(both, F.col("ids"), F.lit(None).cast("string"))


def by_rule() -> Column:
    """A deterministic stand-in for a model: each event relates its first name to each other one, over its own time."""
    pair = lambda name: F.struct(F.lit("related_to").alias("relation_type"), F.element_at("entity_names", 1).alias("subject"), name.alias("object_entity"), F.col("time_start"), F.col("time_end"), F.lit(1.0).alias("confidence"))
    others = F.slice("entity_names", F.lit(2), F.greatest(F.size("entity_names") - 1, F.lit(0)))
    return F.to_json(F.struct(F.transform(others, pair).alias("relations")))


def keep_relevant(relations: DataFrame, provider: Provider | None, *, order: str = "relation_id") -> DataFrame:
    """One request over all relations (column relations: a JSON list, in the order of `order`) names the places that
    matter (from 0; repeated and unknown ones are harmless). No provider, no relation, or an answer that does not parse:
    all stay. Meant for the few relations of one question."""
    if provider is None:
        return relations
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.to_json(F.struct(*relations.columns)).alias("r"))))
    asked = relations.agg(listed.alias("l")).select(F.lit("filter").alias("request_id"), F.transform("l", lambda x: x["r"]).alias("l")).withColumn("relations", F.to_json("l"))
    told = provider.respond(asked).select(answer("response", ANSWERS["filter"]).alias("a"))
    keys = asked.crossJoin(F.broadcast(told)).select(F.posexplode("l").alias("i", "r"), F.col("a.relevant_indices").alias("wanted"))
    kept = keys.where(F.col("wanted").isNull() | F.array_contains("wanted", F.col("i"))).select(F.get_json_object("r", f"$.{order}").alias(order))
    return relations.join(kept, order, "left_semi")


def in_time(relations: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Without a model: relations whose time meets [start, end]; a missing bound is open, a relation without a time goes."""
    from ..plans.questions import filter_time

    return filter_time(relations, start, end)
