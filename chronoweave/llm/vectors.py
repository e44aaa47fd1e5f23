"""Vectors as rows: which take part, and lists of bounded size as numpy blocks."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def takes_part(v):
    """Whether an array<double> is not null, empty or zero, and has only finite components."""
    # x - x is 0 for finite x only
    fine = F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def usable(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows (id, v array<double>, label) with an id and a vector that takes part."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), label.alias("label"))
    return rows.where(F.col("id").isNotNull() & takes_part(F.col("v")))


def matrix(column) -> np.ndarray:
    """A list<double> array of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that huge or tiny components neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@contextmanager
def list_batches(spark: SparkSession, rows: int = 16):
    """Arrow batches of few rows while a table of long lists is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
