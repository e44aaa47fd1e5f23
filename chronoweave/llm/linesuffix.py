"""Repeated runs of lines, found on a suffix array over line ids by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Saved, fresh, small, text_batches
from .mixing import words

#: A repeated run of lines counts if it has so many words.
MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _key() -> tuple[Column, Column]:
    """A document is its id (null: last) and its text's hash; repeated rows are one document."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.col("text").cast("string"))


def _ranked(df: DataFrame, by: list[str], name: str) -> Saved:
    """Distinct rows `by` with a rank that rises in their order: ids of a range-sorted table are in its order. Written
    once, as such ids would change if computed again."""
    return Saved(df.orderBy(*by).withColumn("r", F.monotonically_increasing_id()), name)


def suffix_levels(lines: DataFrame) -> list[Saved]:
    """lines: (k1, k2, pos, h1, h2), one row per line. Level j has (k1, k2, pos, r) for each position at which 2^j
    lines begin that begin elsewhere too; r ranks these line runs in lexicographic order of line ids. So sorting
    positions by r is the suffix array cut at 2^j lines, and positions of equal r are its intervals whose longest
    common prefix is 2^j lines or more. A round pairs the ranks at pos and pos + 2^j and ranks the pairs that occur
    twice or more; other suffixes are told apart already and leave. Counts are combined before each shuffle; only
    distinct pairs are sorted, so a hot line costs one row there."""
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ids = _ranked(repeated, ["h1", "h2"], "line-ids")
    level = Saved(lines.join(ids.df, ["h1", "h2"]).select("k1", "k2", "pos", "r"), "level")
    ids.drop()
    levels, span = [level], 1
    while True:
        right = level.df.select("k1", "k2", (F.col("pos") - span).alias("pos"), F.col("r").alias("r2"))
        pairs = Saved(level.df.withColumnRenamed("r", "r1").join(right, ["k1", "k2", "pos"]), "pairs")
        twice = pairs.df.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ranks = _ranked(twice, ["r1", "r2"], "ranks")
        if not ranks.count():
            pairs.drop(), ranks.drop()
            return levels
        level = Saved(pairs.df.join(ranks.df, ["r1", "r2"]).select("k1", "k2", "pos", "r"), "level")
        pairs.drop(), ranks.drop()
        levels.append(level)
        span *= 2


def _windows(rows: DataFrame, least: int) -> DataFrame:
    """rows: one row per document with at: array of (pos, w), sorted: its repeated lines. Gives the shortest windows of
    adjacent lines with `least` words from each line on, and up to each line: (k1, k2, start, size). A maximal repeated
    run of so many words is the union of such windows within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k1, k2, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                flat = at.values.flatten()
                pos, w = flat[0].to_numpy(zero_copy_only=False).astype(np.int64), flat[1].to_numpy(zero_copy_only=False).astype(np.int64)
                breaks = np.flatnonzero(np.diff(pos) != 1) + 1
                for lo, hi in zip([0, *breaks], [*breaks, len(pos)], strict=True):
                    total = np.concatenate([[0], np.cumsum(w[lo:hi])])
                    if total[-1] < least:
                        continue
                    end = np.searchsorted(total, total[:-1] + least)  # first end for each start
                    begin = np.searchsorted(total, total[1:] - least, side="right") - 1  # last start for each end
                    s = np.arange(hi - lo)
                    fits, back = end <= hi - lo, total[1:] >= least
                    spans = {*zip(s[fits].tolist(), end[fits].tolist(), strict=True), *zip(begin[back].tolist(), (s[back] + 1).tolist(), strict=True)}
                    for a, z in spans:
                        for column, x in zip(out, (k1, k2, int(pos[lo]) + a, z - a), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["k1", "k2", "start", "size"])

    return rows.select("k1", "k2", "at").mapInArrow(run, "k1 long, k2 long, start int, size int")


def removals(docs: DataFrame, *, min_words: int = MIN_WORDS) -> tuple[Saved, int]:
    """What leaves each document: rows (k1, k2, spans array of (start, size) or null for the whole text), and the number
    of spans. A line leaves if it lies in a run of adjacent lines, of min_words or more in all, whose equal stands
    earlier in the order of (doc_id, text hash, line)."""
    k1, k2 = _key()
    text = F.col("text").cast("string")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    slim = Saved(keyed.select("k1", "k2", F.xxhash64(text, F.lit(1)).alias("k3"), words(text).alias("w")).where(F.col("w") >= min_words), "texts")
    firsts = slim.df.groupBy("k2", "k3").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first < last")
    copies = Saved(slim.df.join(firsts, ["k2", "k3"]).where("k1 > first").select("k1", "k2").distinct(), "copies")
    slim.drop()
    n_copies = copies.count()
    # shorter texts hold no run of so many words
    cut = keyed.where(words(text) >= min_words).select("k1", "k2", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = cut.select("k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), words(F.col("line")).cast("int").alias("w"))
    lines = Saved(lines.join(small(copies.df, n_copies), ["k1", "k2"], "left_anti"), "lines")
    # repeated rows give the same lines twice
    if lines.df.groupBy("k1", "k2", "pos").count().where("count > 1").limit(1).count():
        once = Saved(lines.df.dropDuplicates(["k1", "k2", "pos"]), "lines")
        lines.drop()
        lines = once
    levels = suffix_levels(lines.df.select("k1", "k2", "pos", "h1", "h2"))
    per_doc = lines.df.join(levels[0].df.select("k1", "k2", "pos"), ["k1", "k2", "pos"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("at"))
    ranks = levels[0].df.withColumn("j", F.lit(0))
    for j, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.df.withColumn("j", F.lit(j)))
    windows = _windows(per_doc, min_words).withColumn("j", F.floor(F.log2(F.col("size") + 0.5)).cast("int"))
    head = ranks.select("k1", "k2", "j", F.col("pos").alias("start"), F.col("r").alias("r1"))
    tail = ranks.select("k1", "k2", "j", F.col("pos").alias("there"), F.col("r").alias("r2"))
    there = F.col("start") + F.col("size") - F.pow(F.lit(2.0), F.col("j")).cast("int")
    named = Saved(windows.join(head, ["k1", "k2", "j", "start"]).withColumn("there", there).join(tail, ["k1", "k2", "j", "there"]).select("k1", "k2", "start", "size", "r1", "r2"), "windows")
    lines.drop()
    place = F.struct("k1", "k2", "start")
    earliest = named.df.groupBy("size", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = named.df.join(earliest, ["size", "r1", "r2"]).where(place > F.col("first"))
    spans = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    whole = copies.df.withColumn("spans", F.lit(None).cast("array<struct<start:int,size:int>>"))
    out = Saved(spans.unionByName(whole), "removals")
    for t in (*levels, named, copies):
        t.drop()
    n = out.df.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.coalesce(F.size("spans"), F.lit(1)))), F.lit(0))).first()[0]
    return out, n


def clean(docs: DataFrame, *, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with text less its removed lines, and three columns more, whose names are returned: lines, removed lines
    (long), and their ranges ("first-last", zero based, comma-joined). The first copy of every run stays; texts of
    fewer words, null and empty ones (0 lines if null) stay as they are. Repeated rows (same id and text) are one
    document and share its decisions; rows of the same id and other texts are documents of their own; a null id comes
    last. Other columns, whatever their names, are kept. An empty table gives none. Texts are not shuffled while the
    spans are few (BROADCAST_ROWS), beyond that they are joined by shuffling; the result is the same."""
    text_batches(docs.sparkSession)
    columns = docs.columns
    found, n = removals(docs, min_words=min_words)
    c1, c2, whole, spans, hit, *more = fresh(docs, "k1", "k2", "whole", "spans", "hit", "n_lines", "n_removed", "removed")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, ranges = [], [], []
            for value, gone, touched in zip(b.column(whole), b.column(spans), b.column(hit), strict=True):
                text = value.as_py()
                kept, k, where = _without(text, gone.as_py()) if touched.as_py() and text is not None else (text, 0, "")
                texts.append(kept), removed.append(k), ranges.append(where)
            own = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, b.column(more[0]), pa.array(removed, pa.int64()), pa.array(ranges, pa.string())], names=[*columns, *more])

    text = F.col("text").cast("string")
    k1, k2 = _key()
    hits = found.df.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("spans").alias(spans), F.lit(True).alias(hit))
    marked = docs.withColumn(c1, k1).withColumn(c2, k2).join(small(hits, n, BROADCAST_ROWS), [c1, c2], "left")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = marked.select(*columns, text.alias(whole), spans, F.coalesce(hit, F.lit(False)).alias(hit), n_lines.alias(more[0]))
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields]
    added = [T.StructField(c, kind) for c, kind in zip(more, (T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return rows.mapInArrow(rebuilt, T.StructType([*fields, *added])), more


def _without(text: str, spans: list[dict] | None) -> tuple[str, int, str]:
    """The text less the lines of the spans (null: all), how many left, and their ranges."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for s in spans if spans is not None else [{"start": 0, "size": len(lines)}]:
        gone[s["start"]] += 1
        gone[s["start"] + s["size"]] -= 1
    dead = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], dead.view(np.int8), [0]])))
    ranges = ",".join(f"{a}-{z - 1}" for a, z in zip(edges[::2], edges[1::2], strict=True))
    return "\n".join(x for x, d in zip(lines, dead, strict=True) if not d), int(dead.sum()), ranges


def report(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, removed, kept_sha256 (of the remaining text; null for a null text)."""
    out, (lines, gone, ranges) = clean(docs.select("doc_id", "text"), min_words=min_words)
    return out.select(F.col("doc_id").cast("long"), F.col(lines).alias("n_lines"), F.col(gone).alias("n_removed"), F.col(ranges).alias("removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with the same columns, less the removed lines; a document of which no word is left goes. n_chars, if there,
    follows the text."""
    out, (_, gone, _) = clean(docs, min_words=min_words)
    out = out.where((F.col(gone) == 0) | (F.trim(F.regexp_replace("text", r"\s", "")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
