"""Near copies of embeddings: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, components, small
from .vectors import list_batches, matrix, takes_part, unit, usable

#: Least cosine of a link.
COSINE = 0.98
#: Bits of a substring of a code, at least, and tables, one for each substring. Codes that differ in fewer bits than there
#: are tables always meet in one; at cosine 0.98 codes differ in 4 of 64 bits on average.
TABLE_BITS, TABLES = 8, 8
#: The share of links at the least cosine that may meet in no table, by which the number of tables is chosen.
MISSED = 0.001
#: Vectors that the rotation is learned on, at most; passes over them.
SAMPLE, PASSES = 8_192, 50
#: Vectors in a block: a bucket is compared block by block.
BLOCK = 512


def shape(n: int, cosine: float, block: int, table_bits: int | None = None) -> tuple[int, int]:
    """(bits of a substring, tables) for n vectors of a label. Substrings grow by a bit whenever n doubles, so that a
    bucket of evenly spread vectors holds a block or less at every size; two vectors at `cosine` agree in a substring with
    probability (1 - angle / pi) ^ bits, and there are as many tables as keep the share MISSED."""
    bits = table_bits or min(30, max(TABLE_BITS, math.ceil(math.log2(max(1, n / block)))))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, TABLES if agree >= 1 else max(TABLES, math.ceil(math.log(MISSED) / math.log(1 - agree)))


def _rotated(x: np.ndarray, mean: np.ndarray, bits: int, passes: int, rng) -> np.ndarray:
    """Projection d x bits: principal axes about `mean`, then the rotation that brings the projected data nearest to its
    own signs, found by turns. Fewer axes than bits: several rotations from different starts."""
    d = len(mean)
    v = x - mean
    values, axes = np.linalg.eigh(v.T @ v / max(1, len(x)))
    axes = axes[:, np.argsort(-values, kind="stable")[:bits]]
    v, k = v @ axes, min(d, bits)
    parts = []
    for _ in range(-(-bits // k)):
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(passes if len(x) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        parts.append(axes @ r)
    return np.concatenate(parts, 1)[:, :bits]


def learn(x: np.ndarray, *, bits: int = TABLE_BITS * TABLES, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(offset, projection d x bits) for unit vectors x. Half of the bits are of vectors about their mean, which balances
    them; half about the origin, where the angle between two vectors alone decides how many bits differ, however
    crowded the vectors are."""
    d, rng = x.shape[1], np.random.default_rng(seed)
    mean = x.mean(0) if len(x) else np.zeros(d)
    about_mean = _rotated(x, mean, bits // 2, passes, rng)
    about_origin = _rotated(x, np.zeros(d), bits - bits // 2, passes, rng)
    return np.concatenate([mean @ about_mean, np.zeros(about_origin.shape[1])]), np.concatenate([about_mean, about_origin], 1)


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], table_bits: int = TABLE_BITS) -> np.ndarray:
    """A column for every table: the substring's signs as a number."""
    signs = unit(x) @ model[1] >= model[0]
    return (signs.reshape(len(x), -1, table_bits) @ (1 << np.arange(table_bits - 1, -1, -1))).astype(np.int32)


def _train(rows: DataFrame, sample: int, bits: int) -> dict[int, tuple]:
    """A model for every length of vector in the sample: the rows of the smallest hashes."""
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(5)), "id", "v").limit(sample).toPandas()
    models = {}
    for d, part in drawn.groupby(drawn["v"].map(len)):
        models[int(d)] = learn(unit(np.stack(part["v"].to_numpy())), bits=bits)
    return models


def _coded(rows: DataFrame, models: dict[int, tuple], table_bits: int, tables: int) -> DataFrame:
    """Adds code, a number for every table, to rows (label, v, ...): one row per distinct vector of a label."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, tables), np.int32)
            lengths = np.array([len(v) for v in b.column("v")])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                model = sent.value.get(int(d)) or learn(np.zeros((0, int(d))), bits=table_bits * tables)
                out[at] = codes(matrix(b.column("v").take(pa.array(at))), model, table_bits)
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, code], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, "cls long, label int, v array<double>, n long, least long, code array<int>")


def _compare(least: float) -> object:
    def parts(mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        left = mask.any(1)
        while left.any():
            seed = int(np.argmax(left))
            seen = np.zeros(len(mask), bool)
            seen[seed] = True
            front = np.array([seed])
            while len(front):
                new = mask[front].any(0) & ~seen
                seen |= new
                front = np.flatnonzero(new)
            left &= ~seen
            yield seed, np.flatnonzero(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x_out, y_out, link = [], [], []
            for t, i, j, rows in zip(b.column("t").to_pylist(), b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("rows"), strict=True):
                s = rows.values
                cls, n, block = (s.field(c).to_numpy(zero_copy_only=False) for c in ("cls", "n", "b"))
                code = matrix(s.field("code"))
                x = unit(matrix(s.field("v")))
                met = x @ x.T >= least
                np.fill_diagonal(met, False)
                if i != j:
                    met &= block[:, None] != block[None, :]
                if not met.any():
                    continue
                a, z = np.nonzero(met)
                first = np.ones(len(a), bool)  # a pair counts in the first table that it meets in
                for earlier in range(t):
                    first &= code[a, earlier] != code[z, earlier]
                sums = np.bincount(a[first], weights=n[z[first]].astype(float), minlength=len(cls)).astype(np.int64)
                hit = np.flatnonzero(sums)
                x_out += cls[hit].tolist()
                y_out += sums[hit].tolist()
                link += [False] * len(hit)
                for seed, members in parts(met):
                    rest = members[members != seed]
                    x_out += [int(cls[seed])] * len(rest)
                    y_out += cls[rest].tolist()
                    link += [True] * len(rest)
            yield pa.RecordBatch.from_arrays([pa.array(x_out, pa.int64()), pa.array(y_out, pa.int64()), pa.array(link, pa.bool_())], names=["x", "y", "link"])

    return run


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, table_bits: int | None = None) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id that links reach), kept (vec_id = component_id).

    Compared are rows of equal labels and lengths. Equal vectors of a label become one row with a count, so copies meet
    nowhere. A code of signs is cut into substrings; each is a table, and vectors that share a bucket are reranked: the
    cosine of the original vectors, in double precision, must reach `cosine`. shape says how long substrings are
    (table_bits: so long instead) and how many. A bucket of more than `block`
    vectors is compared as pairs of blocks, each a task of its own, so that no list is longer than two blocks. A
    block pair yields counts (a pair counted in the first table that it meets in) and a spanning forest of its links,
    never all pairs. Rows whose vector is null, empty, zero or not finite, or whose label or id is null, have no links and
    are kept as their own component. Repeated rows are rows. An empty table gives no rows."""
    spark = vectors.sparkSession
    good = Saved(usable(vectors).where("label is not null").withColumn("label", F.col("label").cast("int")), "vectors")
    distinct = good.df.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    numbered = Saved(distinct.select(F.monotonically_increasing_id().alias("cls"), "label", "v", "n", "least"), "distinct")
    largest = numbered.df.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, cosine, block, table_bits)
    coded = Saved(_coded(numbered.df, _train(good.df, sample, bits * tables), bits, tables), "codes")
    cells = coded.df.select("cls", "label", F.size("v").alias("d"), F.posexplode("code").alias("t", "value"))
    sizes = Saved(cells.groupBy("label", "d", "t", "value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "sizes")
    full = coded.df.select("cls", "label", F.size("v").alias("d"), "code", "n", "v", F.posexplode("code").alias("t", "value"))
    placed = full.join(small(sizes.df.drop("m"), sizes.count()), ["label", "d", "t", "value"])
    placed = placed.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    lists = placed.groupBy("label", "d", "t", "value", "i", "j").agg(F.collect_list(F.struct("cls", "code", "n", "b", "v")).alias("rows"))
    with list_batches(spark):
        found = Saved(lists.select("t", "i", "j", "rows").mapInArrow(_compare(cosine), "x long, y long, link boolean"), "found")
    sizes.drop()
    links = found.df.where("not link").groupBy(F.col("x").alias("cls")).agg(F.sum("y").alias("links"))
    comp = components(found.df.where("link").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "cls")
    known = Saved(coded.df.select("cls", "label", "v", "n", "least").join(links, "cls", "left").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "known")
    lowest = known.df.groupBy("component").agg(F.min("least").alias("component_id"))
    final = Saved(known.df.join(lowest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    ids = good.df.join(final.df, ["label", "v"]).select("id", "n_links", "component_id")
    rest = vectors.withColumn("_fit", takes_part(F.col("embedding").cast("array<double>")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where("not _fit")
    alone = rest.select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = ids.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
