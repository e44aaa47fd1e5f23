"""The training-data pipeline: quality, repeated lines, near copies, source weights, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, linesuffix, mixing, omh, quality
from chronoweave.llm.common import Saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is below 0.7 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; so do documents of which nothing is left."""
    return linesuffix.drop_repeats(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the smallest id."""
    return omh.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts: doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes."""
    path, pattern = bpe.public_rank_file()
    return bpe.encode_documents(docs, path, pattern).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: No SQL: the stages learn scores, sort suffixes, align shingles and merge bytes; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Saved(docs, f"stage-{k}").df
    return docs
