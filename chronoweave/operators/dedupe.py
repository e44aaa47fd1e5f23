"""Events told more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import _let, granularity_score, parse, strip, to_text
from .ranking import first_wins


def exact(events: DataFrame, *, within: str = "chunk_id") -> DataFrame:
    """Per chunk, of equal sentence, time expression and description the first by ord."""
    return first_wins(events, [within, "original_sentence", "time_expression", "event_description"], [F.col("ord")])


def _time_key(c: str) -> Column:
    """A text that begins another's, or that another's begins, just where the times are compatible (temporal.compatible):
    dates in full form, other texts marked and closed so that only equal ones agree, and a mark for none."""
    t = F.col(c)
    return F.when(t.isNull() | (t == ""), "-").otherwise(F.coalesce(to_text(parse(t)), F.concat(F.lit("?"), t, F.lit("\n"))))


def _agree(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def overlapping(events: DataFrame) -> DataFrame:
    """Per document and description (trimmed, in lower case) events go, in the order of ord, to the first subgroup whose
    first event has a compatible time; of each subgroup the event of the finest time is kept (the earliest, where
    equal), with the chunks of all: event columns, chunk_ids, n_merged.

    Which subgroup an event joins depends on those before it, so a group is folded in order: the fold keeps the first
    event's times of each subgroup and every event's subgroup number. A group is what one document tells in the same
    words; its size is bounded by the document."""
    score = granularity_score("time_start") + granularity_score("time_end")
    e = events.select("doc_id", F.lower(strip("event_description")).alias("_key"), "ord", "event_id", "time_type", _time_key("time_start").alias("s"), _time_key("time_end").alias("e"), "chunk_id", score.alias("score"))
    groups = e.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_list(F.struct("ord", "event_id", "time_type", "s", "e", "chunk_id", "score"))).alias("g"))
    head = lambda x: F.array(F.struct(x["time_type"].cast("string").alias("time_type"), x["s"].alias("s"), x["e"].alias("e")))

    def put(acc: Column, x: Column) -> Column:
        fits = F.transform(acc["heads"], lambda h: F.coalesce((h["time_type"] == x["time_type"]) & _agree(h["s"], x["s"]) & _agree(h["e"], x["e"]), F.lit(False)))

        def placed(at: Column) -> Column:
            heads = F.when(at > 0, acc["heads"]).otherwise(F.concat(acc["heads"], head(x)))
            number = F.when(at > 0, at).otherwise(F.size(acc["heads"]) + 1)
            return F.struct(heads.alias("heads"), F.concat(acc["at"], F.array(number)).alias("at"))

        return _let(F.array_position(fits, True).cast("int"), placed)  # the first, from 1; 0: none

    empty = F.struct(F.array().cast("array<struct<time_type:string,s:string,e:string>>").alias("heads"), F.array().cast("array<int>").alias("at"))
    folded = groups.select("doc_id", "_key", "g", F.aggregate("g", empty, put, lambda acc: acc["at"]).alias("at"))
    rows = folded.select("doc_id", "_key", F.explode(F.arrays_zip("g", "at")).alias("x")).select("doc_id", "_key", "x.at", "x.g.*")
    best = F.max_by("event_id", F.struct("score", (-F.col("ord")).alias("o")))
    chunks = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]))
    kept = rows.groupBy("doc_id", "_key", "at").agg(best.alias("event_id"), chunks.alias("chunk_ids"), F.count(F.lit(1)).cast("int").alias("n_merged"))
    return events.join(kept.select("event_id", "chunk_ids", "n_merged"), "event_id")
