"""Readers and writers; all of them go through Spark, so any path that Spark reads will do."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.ranking import last_wins
from ..schemas import CHUNK, DOCUMENT, EDGE, EVENT, NODE, PLAN, QUESTION

__all__ = ["append", "documents", "events", "exists", "graph_from_folders", "graph_from_graphml", "graph_from_json", "graph_to_graphml", "graph_to_json", "last_plan", "question", "read_chunks", "read_stage", "save_result", "stage_path", "write_stage"]

STAGES = {"event": EVENT, "validate": EVENT, "filter": EVENT, "chunk": CHUNK}


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, path: str, index: int | None = None) -> DataFrame:
    """A corpus file: a list of documents, or an object with them under `documents`. index: that one only, an IndexError
    if there is none. doc_id, title, content, source_idx, ord."""
    raw = _json(spark, path, f"{DOCUMENT}, documents array<struct<{DOCUMENT.replace(' string', ':string')}>>")
    wrapped = raw.where("documents is not null").select(F.posexplode("documents").alias("ord", "d")).select("ord", "d.*")
    flat = raw.where("documents is null").drop("documents").withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())) - 1)
    out = wrapped.unionByName(flat.select(wrapped.columns))
    if index is None:
        return out
    one = out.where(F.col("ord") == index)
    if not one.limit(1).count():
        raise IndexError(f"no document {index} in {path}")
    return one


def stage_path(base: str, stage: str, split: str, index: int | None = None) -> str:
    return f"{base.rstrip('/')}/{stage}/{split}" + ("" if index is None else f"_doc{index}")


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_stage(spark: SparkSession, base: str, split: str, stages: tuple[str, ...] = ("filter", "validate", "event"), index: int | None = None) -> DataFrame:
    """The first of the stages that has been written."""
    for stage in stages:
        path = stage_path(base, stage, split, index)
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {', '.join(stages)} has been written for {split} under {base}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk stage's table, or a JSON list of chunks."""
    return _json(spark, path, CHUNK) if path.endswith(".json") else spark.read.parquet(path)


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).save(path)


def last_plan(spark: SparkSession, path: str) -> DataFrame:
    """The last plan of a file with one plan or a list of them."""
    rows = _json(spark, path, PLAN).withColumn("ord", F.monotonically_increasing_id())
    return rows.orderBy(F.col("ord").desc()).limit(1).drop("ord")


def question(spark: SparkSession, path: str) -> DataFrame | None:
    """A question's analysis, one row; None where the file is missing or is none, so that a search goes on without it."""
    if not exists(spark, path):
        return None
    rows = _json(spark, path, QUESTION).where("original_question is not null").limit(1)
    return rows if rows.count() else None


def events(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of events, with ord: their place in the list."""
    raw = _json(spark, path, EVENT).withColumn("place", F.monotonically_increasing_id())
    return raw.withColumnRenamed("place", "ord")


def save_result(df: DataFrame, folder: str, name: str = "result") -> str:
    """A run's result as JSON lines in a folder of its own, named by the time; returns its path."""
    path = f"{folder.rstrip('/')}/{name}-{datetime.now(UTC):%Y%m%d-%H%M%S-%f}"
    df.write.json(path)
    return path


def _list(c: str):
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def _graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """nodes (NODE columns, ord) and edges (source, target, edge_type, role, order, ord). Of equal keys the last wins."""
    kind = lambda k: nodes.where(F.col("node_type") == k)
    ents = last_wins(kind("entity"), ["canonical_name"], "ord").select("id", F.col("canonical_name").alias("name"), "ord", "cluster_id", "description", _list("source_event_ids").alias("source_event_ids"), _list("aliases").alias("aliases"))
    evs = last_wins(kind("event"), ["event_id"], "ord").select("id", "event_id", "ord", "event_description", "time_type", "time_start", "time_end", "time_expression", "original_sentence", "chunk_id", "doc_id", "doc_title", _list("entity_names").alias("entity_names"))
    tls = last_wins(kind("timeline"), ["timeline_id"], "ord").select("id", "timeline_id", "ord", "timeline_name", "description", "entity_canonical_name", "time_span_start", "time_span_end", _list("event_ids").alias("event_ids"))
    of = lambda k: edges.where(F.col("edge_type") == k)
    ent = ents.select(F.col("id").alias("source"), "name")
    participates = of("PARTICIPATES_IN").join(ent, "source").join(evs.select(F.col("id").alias("target"), "event_id"), "target").select("name", "event_id", "role", "ord")
    belongs = of("BELONGS_TO").join(evs.select(F.col("id").alias("source"), "event_id"), "source").join(tls.select(F.col("id").alias("target"), "timeline_id"), "target").select("event_id", "timeline_id", F.col("order").alias("position"), "ord")
    has = of("HAS_TIMELINE").join(ent, "source").join(tls.select(F.col("id").alias("target"), "timeline_id"), "target").select("name", "timeline_id", "ord")
    return Graph(ents, evs, tls, participates, belongs, has)


def graph_from_json(spark: SparkSession, path: str) -> Graph:
    """{"nodes": [...], "edges": [...]}."""
    if not path.endswith(".json"):
        raise ValueError(f"not a .json file: {path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    types = lambda ddl: "struct<" + ",".join(":".join(("`" + c.strip().split(" ")[0] + "`", c.strip().split(" ")[1])) for c in ddl.split(",")) + ">"
    raw = _json(spark, path, f"nodes array<{types(NODE)}>, edges array<{types(EDGE)}>")
    nodes = raw.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*")
    edges = raw.select(F.posexplode("edges").alias("ord", "e")).select("ord", "e.*")
    return _graph(nodes, edges)


def graph_from_graphml(spark: SparkSession, path: str) -> Graph:
    """Attributes are <data key=...> elements whose keys are declared at the top; they become columns again."""
    xml = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
    keys = xml("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("of"))

    def flat(tag: str, ends: str, wanted: list[str]) -> DataFrame:
        rows = xml(tag, f"{ends}, data array<struct<_VALUE:string,_key:string>>").withColumn("ord", F.monotonically_increasing_id())
        heads = [c.split(" ")[0] for c in ends.split(", ")]
        pairs = rows.select("ord", *heads, F.explode_outer("data").alias("d")).select("ord", *heads, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        named = pairs.join(keys.where(F.col("of") == tag).select("key", "name"), "key", "left")
        return named.groupBy("ord", *heads).pivot("name", wanted).agg(F.first("value", ignorenulls=True))

    columns = lambda ddl, skip: [c.strip().split(" ")[0] for c in ddl.split(",") if c.strip().split(" ")[0] not in skip]
    nodes = flat("node", "_id string", columns(NODE, ("id",))).withColumnRenamed("_id", "id")
    edges = flat("edge", "_source string, _target string", columns(EDGE, ("source", "target"))).withColumnRenamed("_source", "source").withColumnRenamed("_target", "target").withColumn("order", F.col("order").try_cast("int"))
    return _graph(nodes, edges)


def _tables(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables in the layout that graph files have."""
    text = lambda c: F.to_json(c)
    have = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")

    def node(df: DataFrame, kind: str, key: str, lists: tuple[str, ...], **renamed: str) -> DataFrame:
        columns = []
        for c in (x.strip().split(" ")[0] for x in NODE.split(",")):
            src = renamed.get(c, c)
            value = F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")) if c == "id" else F.lit(kind) if c == "node_type" else text(F.col(src)) if c in lists and src in df.columns else have(df, src).cast("string")
            columns.append(value.alias(c))
        return df.select(*columns)

    nodes = node(g.entities, "entity", "name", ("aliases", "source_event_ids"), canonical_name="name").unionByName(node(g.events, "event", "event_id", ("entity_names",))).unionByName(node(g.timelines, "timeline", "timeline_id", ("event_ids",)))
    at = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    none = F.lit(None)
    edges = g.participates.select(at("entity", "name").alias("source"), at("event", "event_id").alias("target"), F.lit("PARTICIPATES_IN").alias("edge_type"), "role", none.cast("int").alias("order"))
    edges = edges.unionByName(g.belongs.select(at("event", "event_id").alias("source"), at("timeline", "timeline_id").alias("target"), F.lit("BELONGS_TO").alias("edge_type"), none.cast("string").alias("role"), F.col("position").cast("int").alias("order")))
    edges = edges.unionByName(g.has.select(at("entity", "name").alias("source"), at("timeline", "timeline_id").alias("target"), F.lit("HAS_TIMELINE").alias("edge_type"), none.cast("string").alias("role"), none.cast("int").alias("order")))
    return nodes, edges


def graph_to_json(g: Graph, path: str) -> None:
    """Folders nodes and edges of JSON lines, which graphs of any size can be written to in parallel."""
    nodes, edges = _tables(g)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def graph_from_folders(spark: SparkSession, path: str) -> Graph:
    nodes = spark.read.schema(NODE).json(f"{path}/nodes").withColumn("ord", F.monotonically_increasing_id())
    edges = spark.read.schema(EDGE).json(f"{path}/edges").withColumn("ord", F.monotonically_increasing_id())
    return _graph(nodes, edges)


def graph_to_graphml(g: Graph, path: str) -> None:
    """Lines of GraphML, one element each, written by Spark; a head and a tail make them one document."""
    nodes, edges = _tables(g)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    def element(df: DataFrame, tag: str, heads: list[str]) -> DataFrame:
        data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{tag}_{c}">'), esc(F.col(c).cast("string")), F.lit("</data>"))) for c in df.columns if c not in heads]
        attrs = [F.concat(F.lit(f' {h}="'), esc(F.col(h)), F.lit('"')) for h in heads]
        return df.select(F.concat(F.lit(f"<{tag}"), *attrs, F.lit(">"), F.concat_ws("", *data), F.lit(f"</{tag}>")).alias("value"))

    keys = "".join(f'<key id="{tag}_{c}" for="{tag}" attr.name="{c}" attr.type="string"/>' for tag, df, heads in (("node", nodes, ["id"]), ("edge", edges, ["source", "target"])) for c in df.columns if c not in heads)
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, f'<graphml>{keys}<graph edgedefault="directed">')], "part int, value string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "part int, value string")
    body = element(nodes, "node", ["id"]).withColumn("part", F.lit(1)).unionByName(element(edges, "edge", ["source", "target"]).withColumn("part", F.lit(2)))
    # one file is what the format is; graphs to be split are for graph_to_json
    head.unionByName(body, allowMissingColumns=True).unionByName(tail).coalesce(1).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
