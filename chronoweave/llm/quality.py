"""Quality scores learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_batches

#: The score at and above which a document is predicted to be good.
ACCEPT = 0.7
#: Labelled rows and preference pairs that the scorer is fitted on, at most.
MAX_LABELLED, MAX_PAIRS = 12_000, 60_000

_MARKS = tuple(b"!?.,:;|%&#*$<>{}=@_\"'()/\\-+~^[]")
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares and logarithmic counts of byte classes and marks, repeated words, repeated
    neighbours, repeated lines, word lengths. Linear in the text; null counts as empty, all zeros."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    words = text.split()
    lines = text.split("\n")
    w, k = len(words), len(lines)
    kinds = len(set(words))
    same = sum(map(eq, words, words[1:]))
    lasting = sum(map(eq, lines, lines[1:]))
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    marks = counts[list(_MARKS)]
    odd = int(marks.sum() - counts[46] - counts[44])
    out = [
        math.log1p(w), math.log1p(n / w) if w else 0.0, kinds / w if w else 0.0, math.log1p(w / kinds) if w else 0.0,
        same / w if w else 0.0, math.log1p(same), len(set(lines)) / k, math.log1p(lasting),
        upper / (upper + lower + 1), math.log1p(upper), math.log1p(max(0, upper - 2 * (counts[46] + k))), int(counts[_DIGIT].sum()) / (n + 1),
        odd / (w + 1), math.log1p(odd), math.log1p(w / k) if k else 0.0, int(counts[128:].sum()) / (n + 1),
    ]
    return np.concatenate([out, marks / (w + 1), np.log1p(marks)])


N_FEATURES = 16 + 2 * len(_MARKS)


class BradleyTerry:
    """P(a is preferred to b) = sigmoid(w (x_a - x_b)); a document's strength is w x, and its score in [0, 1] puts the
    chosen quantile of the strengths at ACCEPT."""

    def __init__(self, mean, scale, weights, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.strength(x) - self.cut) + math.log(ACCEPT / (1 - ACCEPT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, label: np.ndarray, *, pairs: int = MAX_PAIRS, ridge: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Draws preference pairs (a good document, a bad one), minimises the logistic loss on their feature differences
    by Newton's method, then chooses the quantile of the strengths that best tells the labels apart (mean of both
    classes' hit rates) as the threshold. With one class only there are no pairs: weights 0, every score ACCEPT."""
    d = x.shape[1] if x.ndim == 2 and len(x) else N_FEATURES
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, max(len(good), len(bad)) * 16)
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(d)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(diff @ w)).mean() + ridge / 2 * (w @ w))

    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # of the wrong order
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(d)
        step, now, t = np.linalg.solve(hess, grad), loss(w), 1.0
        while loss(w - t * step) > now and t > 1e-4:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(label[order] == 0), np.cumsum(label[order] == 1)
    gain = below_bad / len(bad) - below_good / len(good)
    gain[:-1][s[order][:-1] == s[order][1:]] = -1  # no cut between ties
    at = int(np.argmax(gain))
    nxt = s[order[min(at + 1, len(s) - 1)]]
    cut = float((s[order[at]] + nxt) / 2)
    spread = float(np.abs(s - cut).mean()) or 1.0
    return BradleyTerry(mean, scale, w, cut, 3.0 / spread)


def _map_features(rows: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(v.as_py()).tolist() for v in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    return rows.select("text", extra).mapInArrow(run, "label int, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> BradleyTerry:
    """Fits on the labelled rows (labels: doc_id, quality) outside the held-out fold; where there are more than
    max_labelled, on those of the smallest salted hash. Only features of texts reach the driver."""
    text_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "label").limit(max_labelled)
    rows = _map_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label"), "label").toPandas()
    if rows.empty:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0, int))
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy()
    order = np.lexsort([*x.T[::-1], y])  # the order in which rows arrive must not matter
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: BradleyTerry) -> tuple[DataFrame, str]:
    """docs with one column more, whose name is returned (quality_score, or that after underscores where docs has one):
    double in [0, 1]; ACCEPT or more means good. Null and empty texts get the score of no words. Rows, their order of
    columns and any ids are kept; no shuffle."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    name, whole = fresh(docs, "quality_score", "whole")
    rows = docs.withColumn(whole, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(v.as_py()) for v in b.column(b.num_columns - 1)]
            score = sent.value.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64())], names=[*b.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(run, schema), name


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. An empty table gives no rows; without labels of both kinds
    every score is ACCEPT."""
    scored, name = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    score = F.col(name)
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is below ACCEPT, with the same columns."""
    scored, name = score_documents(docs, train(docs, labels))
    return scored.where(F.col(name) >= ACCEPT).select(*docs.columns)
