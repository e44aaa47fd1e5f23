"""Event times: which are well formed, what can be repaired by rule, what an answer repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = r"^\d{4}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?)?$"


def is_valid(c: Column) -> Column:
    """Null, empty, "null" in any case, or YYYY[-MM[-DD]] with month 01-12 and day 01-31 (not by the calendar)."""
    return c.isNull() | (c == "") | (F.lower(c) == "null") | c.rlike(VALID)


def extract(c: Column) -> Column:
    """The first date-like part: a day, else a month, else a year from 1000 to 2100; a part out of range is passed over
    for a coarser one. Null if there is none."""
    day, month, year = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})-(\d{1,2})(?!\d)", r"\b(\d{4})\b"
    part = lambda p, k: F.regexp_extract(c, p, k)
    two = lambda p, k: F.lpad(part(p, k), 2, "0")
    num = lambda p, k: part(p, k).try_cast("int")
    by_day = F.when(num(day, 2).between(1, 12) & num(day, 3).between(1, 31), F.concat_ws("-", part(day, 1), two(day, 2), two(day, 3)))
    by_month = F.when(num(month, 2).between(1, 12), F.concat_ws("-", part(month, 1), two(month, 2)))
    by_year = F.when(num(year, 1).between(1000, 2100), part(year, 1))
    return F.coalesce(by_day, by_month, by_year)


def issues(start: Column, end: Column) -> Column:
    """Names of the fields that are malformed."""
    return F.array_compact(F.array(F.when(~is_valid(start), F.lit("time_start")), F.when(~is_valid(end), F.lit("time_end"))))


def repair(c: Column) -> Column:
    return F.when(is_valid(c), c).otherwise(F.coalesce(extract(c), c))


def validate(events: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Keeps every event; status: valid, rule_fixed, llm_fixed or invalid. answers: event_id, fix (struct time_start,
    time_end) for what rules leave; a null there keeps the old value, "null" clears it, a malformed one is ignored."""
    s, e = F.col("time_start"), F.col("time_end")
    out = events.withColumn("issues", issues(s, e)).withColumn("_s", repair(s)).withColumn("_e", repair(e))
    out = out.withColumn("status", F.when(F.size("issues") == 0, "valid").when(is_valid(F.col("_s")) & is_valid(F.col("_e")), "rule_fixed").otherwise("invalid"))
    out = out.withColumn("time_start", F.col("_s")).withColumn("time_end", F.col("_e")).drop("_s", "_e")
    if answers is None:
        return out
    out = out.join(answers.select("event_id", "fix"), "event_id", "left")
    ask = F.col("status") == "invalid"

    def answered(old: Column, new: Column) -> Column:
        return F.when(~ask | new.isNull() | ~is_valid(new), old).when((F.lower(new) == "null") | (new == ""), F.lit(None)).otherwise(new)

    out = out.withColumn("time_start", answered(F.col("time_start"), F.col("fix.time_start"))).withColumn("time_end", answered(F.col("time_end"), F.col("fix.time_end")))
    ok = is_valid(F.col("time_start")) & is_valid(F.col("time_end"))
    return out.withColumn("status", F.when(ask & ok, "llm_fixed").otherwise(F.col("status"))).drop("fix")


def summary(validated: DataFrame) -> DataFrame:
    return validated.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
