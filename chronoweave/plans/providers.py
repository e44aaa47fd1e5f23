"""Where a language model would answer: a provider gives each request a JSON response."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def respond(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, ...) to (request_id, response)."""


class Replay:
    """Recorded responses: a table (request_id, response). A request without one gets null."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def respond(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id").join(self.responses, "request_id", "left")


class Rules:
    """A column expression over the request."""

    def __init__(self, expression: Column):
        self.expression = expression

    def respond(self, requests: DataFrame) -> DataFrame:
        return requests.select("request_id", self.expression.alias("response"))


class Remote:
    """A function of a list of prompts, called per Arrow batch, tried again up to `retries` times."""

    def __init__(self, call, *, retries: int = 3, prompt: str = "prompt"):
        self.call, self.retries, self.prompt = call, retries, prompt

    def respond(self, requests: DataFrame) -> DataFrame:
        call, retries = self.call, self.retries

        @F.pandas_udf("string")
        def ask(prompts):
            import pandas as pd

            for turn in range(retries):
                try:
                    return pd.Series(list(call(list(prompts))), dtype="object")
                except Exception:
                    if turn == retries - 1:
                        raise
            return prompts

        return requests.select("request_id", ask(F.col(self.prompt)).alias("response"))


def year_events() -> Column:
    """A deterministic extractor over column content: an event for every sentence that names a year from 1000 to 2100,
    with its capitalised words as entities. The response is JSON as a model's would be."""
    sentences = F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\b(1\d{3}|20\d{2}|2100)\b"))

    def event(s: Column) -> Column:
        years = F.regexp_extract_all(s, F.lit(r"\b((?:1\d{3}|20\d{2}|2100)(?:-\d{2}(?:-\d{2})?)?)\b"), F.lit(1))
        names = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b[A-Z][\p{L}]+(?: [A-Z][\p{L}]+)*"), F.lit(0)))
        entities = F.transform(names, lambda n: F.struct(n.alias("name"), n.alias("canonical_name"), F.lit("").alias("description")))
        ranged = F.size(years) > 1
        return F.struct(s.alias("original_sentence"), s.alias("event_description"), entities.alias("entities"), F.when(ranged, "range").otherwise("point").alias("time_type"), years[0].alias("time_start"), F.when(ranged, F.element_at(years, -1)).alias("time_end"), F.array_join(years, " - ").alias("time_expression"))

    return F.to_json(F.struct(F.transform(sentences, event).alias("events")))
