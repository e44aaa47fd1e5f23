"""What the corpus operators share: durable intermediate tables, row checks and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of at most about 64 bytes that may be broadcast: 32 MB at most. Larger sides are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Rows and bytes in one Arrow batch of texts; whole texts may be long, so batches stay small.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, "4m"

_opened: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset and all runs in one
    process (master local, as in tests) it is a new local folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="chronoweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/chronoweave/{name}-{uuid.uuid4().hex}"
    _opened[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _opened.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_opened.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: the shared folder is emptied with it
            return


class Saved:
    """A DataFrame written once as Parquet in the shared folder, so that no executor's loss repeats or changes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else as it is, to be joined by shuffling."""
    return F.broadcast(df) if rows <= most else df


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, as one text may have megabytes. The two settings stay lowered in the
    session, as plans read them when they run, which may be after the caller has the DataFrame."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, TEXT_BATCH_ROWS) if rows > 0 else TEXT_BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b), of one type (long, string or binary) and not null: rows
    (node, component), the component being its smallest node. Randomised contraction: in every round each node moves to the neighbour (or
    itself) of the smallest salted hash, and the edges are rewritten between these, which leaves a constant share of
    the nodes, so rounds grow with the logarithm of the nodes also on long chains. A hub vanishes in its first round;
    every minimum is combined before its shuffle. Edges and maps are tables in the shared folder; loops and repeated
    edges are harmless; nodes without an edge to another node do not appear."""
    spark = edges.sparkSession
    level = Saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[Saved] = []
    while level.df.limit(1).count():
        salt = F.lit(len(moves))
        one = F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("to"))
        both = level.df.unionByName(level.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(one).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("to"))
        move = Saved(least.select("a", F.least("m", own)["to"].alias("to")), "moves")
        moves.append(move)
        left = move.df.select(F.col("a"), F.col("to").alias("na"))
        right = move.df.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        cut = level.df.join(left, "a").join(right, "b").where("na <> nb")
        after = Saved(cut.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
        level.drop()
        level = after
    level.drop()
    if not moves:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField(c, kind) for c in ("node", "component")]))
    found = moves[-1].df.select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        # nodes that a later round does not know have reached their root
        here = move.df.select(F.col("a").alias("node"), F.col("to").alias("via"))
        later = found.select(F.col("node").alias("via"), "root")
        found = here.join(later, "via", "left").select("node", F.coalesce("root", "via").alias("root"))
    roots = Saved(found, "roots")
    for move in moves:
        move.drop()
    lowest = roots.df.groupBy("root").agg(F.min("node").alias("component"))
    return roots.df.join(lowest, "root").select("node", "component")
