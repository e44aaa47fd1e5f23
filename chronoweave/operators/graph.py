"""The property graph as tables: entities, events and timelines are nodes, three kinds of edges join them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import year_prefix
from .ranking import first_wins, last_wins


@dataclass
class Graph:
    """entities (name, ord, description, aliases, ...), events (event_id, ord, ...), timelines (timeline_id, ord, ...);
    edges: participates (name, event_id, role, ord), belongs (event_id, timeline_id, position, ord), has (name,
    timeline_id, ord). ord is the order of insertion. Several edges between two nodes are kept: each counts as a vote."""

    entities: DataFrame
    events: DataFrame
    timelines: DataFrame
    participates: DataFrame
    belongs: DataFrame
    has: DataFrame

    # look-ups
    def entity(self, name: str) -> DataFrame:
        return self.entities.where(F.col("name") == name)

    def event(self, event_id: str) -> DataFrame:
        return self.events.where(F.col("event_id") == event_id)

    def timeline(self, timeline_id: str) -> DataFrame:
        return self.timelines.where(F.col("timeline_id") == timeline_id)

    # traversals; each takes a table of start nodes and gives a row per edge
    def entity_events(self, entities: DataFrame) -> DataFrame:
        edges = self.participates.withColumnRenamed("ord", "edge_ord")
        return entities.select("name").join(edges, "name").join(self.events, "event_id")

    def entity_timelines(self, entities: DataFrame) -> DataFrame:
        return entities.select("name").join(self.has.withColumnRenamed("ord", "edge_ord"), "name").join(self.timelines, "timeline_id")

    def event_entities(self, events: DataFrame) -> DataFrame:
        return events.select("event_id").join(self.participates.withColumnRenamed("ord", "edge_ord"), "event_id").join(self.entities, "name")

    def event_timeline(self, events: DataFrame) -> DataFrame:
        """The first timeline of each event, in order of insertion."""
        first = first_wins(self.belongs.withColumnRenamed("ord", "edge_ord"), ["event_id"], [F.col("edge_ord")])
        return events.select("event_id").join(first, "event_id").join(self.timelines, "timeline_id")

    def timeline_events(self, timelines: DataFrame) -> DataFrame:
        """Events with their position; order by position, edge_ord."""
        return timelines.select("timeline_id").join(self.belongs.withColumnRenamed("ord", "edge_ord"), "timeline_id").join(self.events, "event_id")

    def timeline_entity(self, timelines: DataFrame) -> DataFrame:
        first = first_wins(self.has.withColumnRenamed("ord", "edge_ord"), ["timeline_id"], [F.col("edge_ord")])
        return timelines.select("timeline_id").join(first, "timeline_id").join(self.entities, "name")

    # filters
    def entities_by_name(self, name: str, *, fuzzy: bool = False) -> DataFrame:
        return self.entities.where(name_matches(F.col("name"), F.col("aliases"), name, fuzzy))

    def events_in_years(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return self.events.where(in_years(F.col("time_start"), start, end))

    def stats(self) -> DataFrame:
        """kind (node or edge), type (null: all), n; one pass over each table."""
        parts = [("node", "entity", self.entities), ("node", "event", self.events), ("node", "timeline", self.timelines), ("edge", "participates_in", self.participates), ("edge", "belongs_to", self.belongs), ("edge", "has_timeline", self.has)]
        rows = None
        for kind, name, df in parts:
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("type"), "n")
            rows = one if rows is None else rows.unionByName(one)
        return rows.groupingSets([["kind", "type"], ["kind"]], "kind", "type").agg(F.sum("n").alias("n"))

    def keys(self, kind: str) -> DataFrame:
        """Distinct keys in order of insertion."""
        df, key = {"entity": (self.entities, "name"), "event": (self.events, "event_id"), "timeline": (self.timelines, "timeline_id")}[kind]
        return df.groupBy(key).agg(F.min("ord").alias("ord")).orderBy("ord")


def name_matches(name: Column, aliases: Column, wanted: str, fuzzy: bool) -> Column:
    """Equal to the name or an alias; fuzzy: part of one of them, in any case."""
    if not fuzzy:
        return (name == wanted) | F.coalesce(F.array_contains(aliases, wanted), F.lit(False))
    low = wanted.lower()
    return F.lower(name).contains(low) | F.coalesce(F.exists(aliases, lambda x: F.lower(x).contains(low)), F.lit(False))


def in_years(time: Column, start: str | None, end: str | None) -> Column:
    """Whether the year that a time begins with lies between the bounds' years; blank bounds are open, others must be
    numbers, and years of 0 or none are left out."""

    def bound(text: str | None, default: int) -> int | None:
        if not text:
            return default
        return int(text[:4]) if text[:4].isdigit() else None

    lo, hi = bound(start, 0), bound(end, 9999)
    if lo is None or hi is None:
        return F.lit(False)
    y = year_prefix(time)
    return F.coalesce((y != 0) & y.between(lo, hi), F.lit(False))


def aliases(members: Column, canonical: Column) -> Column:
    """Names of a cluster's members, and canonical names that differ, without the cluster's own; sorted."""
    names = F.array_union(F.transform(members, lambda m: m["name"]), F.transform(members, lambda m: m["canonical_name"]))
    return F.array_sort(F.array_except(F.array_compact(names), F.array(canonical)))


def build(events: DataFrame, clusters: DataFrame, timelines: DataFrame, *, resolve_mentions: bool = True) -> Graph:
    """From pipeline tables, each with ord. An edge needs both its ends. resolve_mentions: an entity mention leads to its
    cluster by any member name; else by the cluster's canonical name only. Of equal keys the last inserted wins."""
    ents = last_wins(clusters, ["canonical_name"], "ord").select(F.col("canonical_name").alias("name"), "ord", "cluster_id", F.col("merged_description").alias("description"), "source_event_ids", aliases(F.col("member_entities"), F.col("canonical_name")).alias("aliases"))
    evs = last_wins(events, ["event_id"], "ord").withColumn("entity_names", F.transform("entities", lambda e: F.coalesce(e["canonical_name"], e["name"])))
    evs = evs.withColumn("time_start", F.coalesce("time_start", F.lit(""))).withColumn("time_end", F.coalesce("time_end", F.lit("")))
    tls = last_wins(timelines, ["timeline_id"], "ord")
    mentions = events.select("event_id", F.col("ord").alias("e"), F.posexplode("entities").alias("m", "x")).select("event_id", "e", "m", F.coalesce("x.canonical_name", "x.name").alias("mention"))
    known = ents.select("name", F.col("name").alias("mention"))
    if resolve_mentions:
        also = ents.select("name", F.explode("aliases").alias("mention"))
        known = first_wins(known.withColumn("p", F.lit(0)).unionByName(also.withColumn("p", F.lit(1))), ["mention"], [F.col("p"), F.col("name")]).drop("p")
    edge = F.struct("e", "m")
    participates = mentions.join(known, "mention").select("name", "event_id", F.lit("participant").alias("role"), edge.alias("ord"))
    listed = tls.select("timeline_id", F.col("ord").alias("t"), F.posexplode("event_ids").alias("position", "event_id"))
    belongs = listed.join(evs.select("event_id"), "event_id", "left_semi").select("event_id", "timeline_id", "position", F.struct("t", "position").alias("ord"))
    owners = tls.join(known.select(F.col("mention").alias("entity_canonical_name"), "name"), "entity_canonical_name").select("name", "timeline_id", "ord")
    return Graph(ents, evs, tls, participates, belongs, owners)


def build_report(graph: Graph) -> DataFrame:
    """The six counts of a build."""
    return graph.stats().where("type is not null").select("type", "n")


def entity_context(events: DataFrame, text: Column, query: str) -> DataFrame:
    """Scores an entity's events by the share of the query's words (repeated ones too) that are part of the text."""
    words = [w for w in query.lower().split() if w]
    hit = sum((F.when(F.lower(text).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return events.withColumn("score", hit / len(words) if words else F.lit(0.0))
