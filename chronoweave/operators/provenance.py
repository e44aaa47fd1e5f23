"""From events back to the chunks they were read in, and the chunks around those."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_doc, chunk_number
from .ranking import first_wins


def event_chunks(events: DataFrame, chunks: DataFrame, *, distinct: bool = False) -> DataFrame:
    """events (event_id, chunk_id or chunk_ids, ord) with their chunks; a merged event has several, comma-joined or in an
    array. distinct: each chunk once, at its first event. Blank and unknown ids give no row."""
    ids = F.col("chunk_ids") if "chunk_ids" in events.columns else F.split("chunk_id", ",")
    rows = events.select("event_id", "ord", F.explode(ids).alias("chunk_id")).where("chunk_id <> ''").join(chunks, "chunk_id")
    return first_wins(rows, ["chunk_id"], [F.col("ord"), F.col("event_id")]) if distinct else rows


def surrounding(wanted: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """wanted (chunk_id): rows centre, chunk_id, offset (negative: before) and the chunk's columns, for neighbours within
    reach that no missing number separates from the centre. Numbers of a document form islands; a neighbour must be of
    the centre's. The reach makes an equi-join: each centre lists the numbers it asks for."""
    c = chunks.withColumn("_doc", chunk_doc("chunk_id")).withColumn("_n", chunk_number("chunk_id")).where("_n is not null")
    c = c.withColumn("_island", F.col("_n") - F.row_number().over(Window.partitionBy("_doc").orderBy("_n")))
    centre = wanted.select("chunk_id").join(c.select("chunk_id", "_doc", "_n", "_island"), "chunk_id").withColumnRenamed("chunk_id", "centre")
    asked = centre.select("centre", "_doc", "_island", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"), "_n").withColumn("_n", F.col("_n") + F.col("offset"))
    return asked.join(c, ["_doc", "_n", "_island"]).drop("_doc", "_n", "_island")


def surrounding_events(events: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    return surrounding(event_chunks(events, chunks, distinct=True).select("chunk_id"), chunks, before, after)


def expand_timelines(hits: DataFrame, timelines: DataFrame, belongs: DataFrame) -> DataFrame:
    """Event hits (event_id, score, rank), then the events of timeline hits (timeline_id, rank) in their order with score
    0; an event counts at its first place: event_id, score, place."""
    own = hits.select("event_id", F.col("score").cast("double").alias("score"), F.struct(F.lit(0).alias("s"), F.col("rank").cast("long").alias("r"), F.lit(0).cast("long").alias("p")).alias("place"))
    more = timelines.select("timeline_id", "rank").join(belongs, "timeline_id").select("event_id", F.lit(0.0).alias("score"), F.struct(F.lit(1).alias("s"), F.col("rank").cast("long").alias("r"), F.col("position").cast("long").alias("p")).alias("place"))
    return own.unionByName(more).groupBy("event_id").agg(F.min_by("score", "place").alias("score"), F.min("place").alias("place"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows (a_id, lo, hi) and (b_id, lo, hi), dates, closed, whose intervals share a day. Each interval is
    listed under its years, so that the join is an equi-join; a pair is taken in the later of both first years only."""
    by_year = lambda d: d.select("*", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("_y")).where("lo <= hi")
    x = by_year(a.where("lo <= hi")).select(*(keys or []), "_y", "a_id", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    y = by_year(b.where("lo <= hi")).select(*(keys or []), "_y", "b_id", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    met = x.join(y, [*(keys or []), "_y"])
    return met.where((F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("_y") == F.greatest(F.year("a_lo"), F.year("b_lo")))).drop("_y")
