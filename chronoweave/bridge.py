"""Views of the star-schema test tables as documents, events, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector as V
from .operators.graph import Graph

#: Texts and ids that the ranked queries ask for.
QUERY = "the retitioning of the theron"
QUERY_VECTOR = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; where they lie in fewer files than there are cores, dealt over the cores, as one file of one row
    group would keep a single core busy with all texts. Larger tables are read as they lie, without a shuffle."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("ord"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("vec_id").alias("ord"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row."""
    return vectors(spark, sf_dir).where(F.col("node_id") == QUERY_VECTOR).select(F.col("embedding").alias("q"))


def scored_vectors(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    """node_id, ord, score (six decimals, so that ties are the same everywhere)."""
    v = vectors(spark, sf_dir).crossJoin(F.broadcast(query_vector(spark, sf_dir)))
    return v.select("node_id", "ord", "label", F.round(V.METRICS[metric](F.col("embedding"), F.col("q")), 6).alias("score"))


def tev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over several years, with times as years, months or days."""
    e = table(spark, sf_dir, "events").withColumn("w", F.expr("ts + make_interval(0, 0, 0, cast(event_id % 1500 as int))"))
    grain = lambda c: F.when(F.col("event_id") % 3 == 0, F.date_format(c, "yyyy")).when(F.col("event_id") % 3 == 1, F.date_format(c, "yyyy-MM")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    ranged = F.col("event_id") % 2 == 0
    return e.select("event_id", F.col("event_id").alias("ord"), "user_id", "event_type", "w", grain(F.col("w")).alias("time_start"), F.when(ranged, grain(F.col("w") + F.expr("interval 7 days"))).alias("time_end"), F.when(ranged, "range").otherwise("point").alias("time_type"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users are entities, (user, type) with two events or more are timelines."""
    e = tev(spark, sf_dir)
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    line = F.concat(name, F.lit("/"), F.col("event_type"))
    sized = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("ord")).where("n >= 2")
    timelines = sized.select(line.alias("timeline_id"), name.alias("entity_canonical_name"), "user_id", "event_type", "ord")
    entities = e.groupBy("user_id").agg(F.min("event_id").alias("ord")).select(name.alias("name"), "ord", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("aliases"))
    from pyspark.sql import Window

    by = Window.partitionBy("user_id", "event_type").orderBy("w", "event_id")
    placed = e.join(sized.select("user_id", "event_type"), ["user_id", "event_type"]).select("event_id", line.alias("timeline_id"), (F.row_number().over(by) - 1).cast("long").alias("position")).withColumn("ord", F.col("position"))
    participates = e.select(name.alias("name"), "event_id", F.lit("participant").alias("role"), F.col("event_id").alias("ord"))
    return Graph(entities, e, timelines, participates, placed, timelines.select(F.col("entity_canonical_name").alias("name"), "timeline_id", "ord"))


def stages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same graph as tables of the extraction's stages: events with mentions, clusters, timelines with event ids."""
    e = tev(spark, sf_dir)
    person = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    mention = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), person.alias("canonical_name"), F.lit("").alias("description"))
    key = F.col("event_id").cast("string")
    events = e.select(key.alias("event_id"), "ord", F.array(mention).alias("entities"), "time_type", "time_start", "time_end")
    clusters = e.groupBy("user_id").agg(F.min("ord").alias("ord"), F.array(F.first(mention)).alias("member_entities"))
    clusters = clusters.select(person.alias("canonical_name"), "ord", person.alias("cluster_id"), F.lit("").alias("merged_description"), F.array().cast("array<string>").alias("source_event_ids"), "member_entities")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("w", "event_id"))), lambda x: x["event_id"].cast("string"))
    lines = e.groupBy("user_id", "event_type").agg(F.min("ord").alias("ord"), listed.alias("event_ids")).where(F.size("event_ids") >= 2)
    return events, clusters, lines.select(F.concat(person, F.lit("/"), F.col("event_type")).alias("timeline_id"), person.alias("entity_canonical_name"), "ord", "event_ids")


def label_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors: event (node_id), entity (label), timeline (label and language)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang")
    return d.join(scored_vectors(spark, sf_dir), "node_id").select("node_id", "ord", "score", F.col("label").cast("string").alias("entity"), F.concat_ws("/", F.col("label").cast("string"), "lang").alias("timeline"))
