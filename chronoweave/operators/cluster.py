"""Entity mentions to entities: greedy clusters by mean similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy(order: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers, in order: a mention that no cluster has yet begins one, and each later free mention joins it if
    its mean similarity to the members so far reaches `least`."""
    n = len(x)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    label = np.full(n, -1)
    rank = np.argsort(order, kind="stable")
    u, number = u[rank], 0
    found = np.full(n, -1)
    for i in range(n):
        if found[i] >= 0:
            continue
        found[i], total, size = number, u[i].copy(), 1
        for j in np.flatnonzero(found[i + 1 :] < 0) + i + 1:
            if total @ u[j] / size >= least:
                found[j], size = number, size + 1
                total += u[j]
        number += 1
    label[rank] = found
    return label


def clusters(mentions: DataFrame, *, least: float = 0.85, block: list[str] | None = None) -> DataFrame:
    """mentions (mention_id, ord, name, canonical_name, description, event_id, embedding, block columns) with cluster_id.
    The greedy pass is sequential, so it runs block by block, a block being mentions that may be one entity; without
    blocks all mentions go through one task. Cluster ids are numbered by their first mention."""
    keys = block or []
    one = mentions.withColumn("_all", F.lit(0)) if not keys else mentions

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["embedding"].to_numpy()).astype(float)
        return frame.assign(_local=greedy(frame["ord"].to_numpy(), x, least))

    schema = T.StructType([*one.schema.fields, T.StructField("_local", T.IntegerType())])
    labelled = one.groupBy(*(keys or ["_all"])).applyInPandas(run, schema)
    names = keys or ["_all"]
    first = labelled.groupBy(*names, "_local").agg(F.min("ord").alias("_first"))
    numbered = first.withColumn("cluster_id", F.format_string("cluster-%04d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first")) - 1))
    return labelled.join(numbered.drop("_first"), [*names, "_local"]).drop("_local", "_all")


def summarise(labelled: DataFrame) -> DataFrame:
    """cluster_id, canonical_name (the longest, the first of equals), merged_description (distinct, sorted, joined by
    "; "), member_count, member_entities, source_event_ids (distinct, sorted, without blanks), ord."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    entity = F.struct("ord", F.struct("name", "canonical_name", "description").alias("e"))
    out = labelled.groupBy("cluster_id").agg(
        F.max_by("canonical_name", F.struct(F.length("canonical_name"), -F.col("ord"))).alias("canonical_name"),
        F.array_join(F.array_sort(F.collect_set(blank("description"))), "; ").alias("merged_description"),
        F.count(F.lit(1)).cast("int").alias("member_count"),
        F.sort_array(F.collect_list(entity)).alias("m"),
        F.array_sort(F.collect_set(blank("event_id"))).alias("source_event_ids"),
        F.min("ord").alias("ord"),
    )
    return out.withColumn("member_entities", F.transform("m", lambda x: x["e"])).drop("m")


def mention_map(labelled: DataFrame) -> DataFrame:
    """text, cluster_id: of equal texts the last mention's cluster."""
    return labelled.groupBy(F.col("canonical_name").alias("text")).agg(F.max_by("cluster_id", "ord").alias("cluster_id"))
