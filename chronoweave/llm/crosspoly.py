"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, small
from .vectors import list_batches, matrix, unit, usable

#: Tables, and cells that a query looks into in each, while one polytope names the cells. It has twice as many signed
#: axes as the (padded) dimension.
TABLES, PROBES = 8, 16
#: The same once cells have `bits` from further polytopes: MORE_TABLES, and MORE_PROBES * PROBE_GROWTH ** bits.
MORE_TABLES, MORE_PROBES, PROBE_GROWTH = 24, 4, 1.3
#: Vectors, and queries, in one block of a cell.
BLOCK = 512
#: Distinct vectors of one length that a cell holds on average, at most: where it would hold more, cells get more bits.
CELL_ROWS = 512
#: Pairs whose exact products are computed at once, and sums of nearness when probes are chosen.
PAIRS, SUMS = 16_384, 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, seed: int = 9) -> np.ndarray:
    """A pseudo-random rotation: three times random signs, then a Hadamard transform, after padding with zeros."""
    d = 1 << max(1, x.shape[1] - 1).bit_length() if x.shape[1] > 1 else 2
    rng = np.random.default_rng([seed, table, d])
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), d))
    return y


def axes(d: int) -> int:
    """Signed axes of the polytope for vectors of d components: a power of two."""
    return 4 if d < 2 else 2 << (d - 1).bit_length()


def cell_bits(d, n, cell_rows: int):
    """Columns: bits beside the first polytope's axis that leave n spread vectors of d components cell_rows a cell or
    fewer. The first polytope has axes(d) axes."""
    polytope = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(2), d) - 0.5)) + 1)
    return F.greatest(F.lit(0), F.ceil(F.log2(n / (polytope * cell_rows)))).cast("int")


def effort(bits: int, tables: int, probes: int) -> tuple[int, int]:
    """Tables, and probes in each, for cells of so many bits; tables and probes are those for none."""
    return (tables, probes) if not bits else (MORE_TABLES, math.ceil(MORE_PROBES * PROBE_GROWTH**bits))


def cells(x: np.ndarray, table: int, probes: int, bits: int = 0) -> np.ndarray:
    """The `probes` cells (all, if fewer) nearest to each row, nearest first. A cell is one signed axis of each
    polytope: 2 * axis, and 1 more where the sign is minus; the first polytope's is the highest digit. Each further
    polytope, of a rotation of its own, adds as many bits as it has, the last the first axes for the bits left. Nearness
    is the sum of the row's components along the axes, so the best cells are made of the best of each polytope."""
    x = unit(x)
    full = axes(x.shape[1]).bit_length() - 1
    names, near = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    left, part = full + bits, 0
    while left > 0:
        here = min(left, full)
        y = rotated(x, table, 9 + part)[:, : 1 << (here - 1)]
        signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
        best = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        good = np.take_along_axis(signed, best, 1)
        total = (near[:, :, None] + good[:, None, :]).reshape(len(x), -1)
        named = ((names[:, :, None] << here) + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        names, near = np.take_along_axis(named, order, 1), np.take_along_axis(total, order, 1)
        left, part = left - here, part + 1
    return names


def _hashed(rows: DataFrame, tables: int, probes: int, asking: bool) -> DataFrame:
    """rows (id, least, v, bits) with d, t and cell: of each table the cell of the row or, asking, all probed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.array([len(v) for v in whole.column("v")])
            bits = whole.column("bits").to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                n = int(bits[lengths == d][0])
                t_all, p_all = effort(n, tables, probes)
                p_all = p_all if asking else 1
                mine = np.flatnonzero(lengths == d)
                step = max(1, SUMS // (p_all * max(p_all, t_all)))
                for lo in range(0, len(mine), step):
                    b = whole.take(pa.array(mine[lo : lo + step])).drop_columns(["bits"])
                    x = matrix(b.column("v"))
                    found = [cells(x, t, p_all, n) for t in range(t_all)]
                    row = pa.array(np.concatenate([np.repeat(np.arange(len(x)), f.shape[1]) for f in found]))
                    t = np.concatenate([np.full(f.size, k) for k, f in enumerate(found)])
                    cell = np.concatenate([f.ravel() for f in found])
                    places = [pa.array(np.full(len(row), d), pa.int32()), pa.array(t, pa.int32()), pa.array(cell, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns), *places], names=[*b.schema.names, "d", "t", "cell"])

    return rows.select("id", "least", "v", "bits").mapInArrow(run, "id long, least long, v array<double>, d int, t int, cell long")


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products added up from the first component to the last, the same wherever they are computed."""
    return np.cumsum(q * x, axis=-1)[..., -1]


def _nearest(k: int):
    """Pairs of blocks (queries, vectors) to the k best vectors of the block for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for mine, there in zip(b.column("queries"), b.column("vectors"), strict=True):
                q_ids = mine.values.field("id").to_numpy(zero_copy_only=False)
                x_ids, least = (there.values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "least"))
                q, x = matrix(mine.values.field("v")), matrix(there.values.field("v"))
                near = q @ x.T
                kth = -np.partition(-near, k - 1, axis=1)[:, k - 1] if k < len(x_ids) else np.full(len(q), -np.inf)
                # all within what rounding may have moved, so that ties at the cut are decided by exact products and ids
                slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
                with np.errstate(invalid="ignore"):
                    row, col = np.nonzero(near >= np.where(np.isfinite(kth), kth - slack, kth)[:, None])
                exact = np.concatenate([np.zeros(0), *(inner(q[row[lo : lo + PAIRS]], x[col[lo : lo + PAIRS]]) for lo in range(0, len(row), PAIRS))])
                order = np.lexsort((x_ids[col], least[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                ok = np.arange(len(row)) - np.searchsorted(row, row) < k
                for column, values in zip(out, (q_ids[row[ok]], x_ids[col[ok]], least[col[ok]], exact[ok]), strict=True):
                    column.append(values)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(np.concatenate(a) if a else np.zeros(0), t) for a, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "x", "least", "score"])

    return run


def _search(queries: DataFrame, index: DataFrame, k: int, block: int) -> DataFrame:
    """queries and index: (id, least, v, d, t, cell). The k best of every block of a cell for the queries that probe it."""
    keys = ["d", "t", "cell"]
    count = F.count(F.lit(1)).alias("m")
    n_vectors = Saved(index.groupBy(*keys).agg(count).select(*keys, F.ceil(F.col("m") / block).cast("int").alias("xb")), "cells")
    n_queries = Saved(queries.groupBy(*keys).agg(count).select(*keys, F.ceil(F.col("m") / block).cast("int").alias("qb")), "cells")
    x = index.join(small(n_vectors.df, n_vectors.count()), keys).withColumn("x", F.pmod(F.xxhash64("id"), F.col("xb")).cast("int"))
    q = queries.join(small(n_queries.df, n_queries.count()), keys).withColumn("q", F.pmod(F.xxhash64("id"), F.col("qb")).cast("int"))
    x = x.groupBy(*keys, "x").agg(F.collect_list(F.struct("id", "least", "v")).alias("vectors"))
    q = q.groupBy(*keys, "q").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    with list_batches(queries.sparkSession):
        out = Saved(q.join(x, keys).select("queries", "vectors").mapInArrow(_nearest(k), "q long, x long, least long, score double"), "near").df
    n_vectors.drop(), n_queries.drop()
    return out


def nearest(vectors: DataFrame, is_query, k: int, *, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each row of vectors (vec_id, embedding) with is_query (a column over id): its k nearest among all other rows
    by inner product: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id.

    Equal vectors are one class, which lists its k + 1 rows of the smallest ids, so a vector that very many rows share
    is met once. Unit vectors are hashed to the nearest signed axis of `tables` pseudo-random rotations; every class is
    indexed in all tables, a query looks into its `probes` nearest axes in each, and what it meets is ranked by the exact
    inner product of the original vectors in double precision; the best k + 1 classes (its own may be one) hold its k
    nearest rows. Where the classes of a length would be more than cell_rows a cell, cells get bits from further
    polytopes (cell_bits), with tables and probes as effort() gives them: a query then meets a number of classes that
    grows as about the 0.4th power of theirs. Approximate: recall is measured in the tests. A query that meets fewer than
    k + 1 classes looks into all cells of the first table, that is at every class of its length. Cells are split into
    blocks, so none grows with a hot cell; each gives a query k + 1 classes at most. Vectors that are null, empty, zero or
    not finite take no part; vectors of other lengths are no candidates. Rows that share an id are rows of their own: each
    is a candidate, and each that asks gets its own answer. An empty table gives no rows."""
    good = Saved(usable(vectors).select("id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    distinct = good.df.groupBy("v").agg(F.min("id").alias("least"))
    classes = Saved(distinct.select(F.monotonically_increasing_id().alias("cls"), "v", "least"), "classes")
    rows = Saved(good.df.join(classes.df.select("cls", "v"), "v").select("cls", "id", "row"), "rows")
    good.drop()
    place = F.row_number().over(Window.partitionBy("cls").orderBy("id", "row"))
    members = rows.df.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    asked = rows.df.where(is_query)
    per_length = classes.df.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("m"))
    lengths = Saved(per_length.select("n", cell_bits(F.col("n"), F.col("m"), cell_rows).alias("bits")), "lengths")
    named = classes.df.withColumn("n", F.size("v")).join(small(lengths.df, lengths.count()), "n").select(F.col("cls").alias("id"), "least", "v", "bits")
    wanted = Saved(named.join(asked.select(F.col("cls").alias("id")).distinct(), "id"), "wanted")
    index = Saved(_hashed(named, tables, probes, False), "index")
    found = _search(_hashed(wanted.df, tables, probes, True), index.df, k + 1, block).distinct()
    served = found.groupBy("q").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k).select(F.col("q").alias("id"))
    short = Saved(wanted.df.join(served, "id", "left_anti"), "short")
    if short.df.limit(1).count():
        first = index.df.where("t = 0")
        filled = Saved(first.select("d", "t", "cell").distinct(), "filled")
        everywhere = short.df.withColumn("d", F.size("v")).join(small(filled.df, filled.count()), "d").select("id", "least", "v", "d", "t", "cell")
        found = found.unionByName(_search(everywhere, first, k + 1, block)).distinct()
        filled.drop()
    by_class = Window.partitionBy("q").orderBy(F.col("score").desc(), "least", "x")
    best = found.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1).select("q", "score", F.col("x").alias("cls"))
    listed = best.join(members, "cls").select("q", F.struct((-F.col("score")).alias("far"), "id", "row", "score").alias("c"))
    by_row = Window.partitionBy("q").orderBy("c")
    listed = listed.withColumn("place", F.row_number().over(by_row)).where(F.col("place") <= k + 1)
    lists = listed.groupBy(F.col("q").alias("cls")).agg(F.array_sort(F.collect_list("c")).alias("all"))
    answers = asked.join(lists, "cls")
    others = F.slice(F.filter("all", lambda c: c["row"] != F.col("row")), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "c"))
    index.drop(), short.drop(), wanted.drop(), classes.drop(), lengths.drop()
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.score").alias("score"))
