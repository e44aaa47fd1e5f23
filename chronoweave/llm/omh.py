"""Near copies by order MinHash on five-word shingles, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Saved, components, fresh, small, text_batches

#: Words in a shingle; least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Sketches (tables), and shingles in one sketch. At similarity s a sketch agrees with probability near s^PICKS, so a
#: pair at 0.8 misses all tables once in 100,000 times.
SKETCHES, PICKS = 16, 3
#: Texts, and shingles of them, in a block: a bucket of several classes is compared block by block.
BLOCK, BLOCK_SHINGLES = 256, 400_000

_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_POWERS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordIds(dict):
    """Word hashes, kept for the common words; emptied when it has grown."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_ids = _WordIds()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(tokens: list[str], k: int = WORDS) -> np.ndarray:
    """Hashes of the k-word shingles in text order, each labelled with how often it occurred before, so that all differ.
    Fewer than k words make one shingle; no words none."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_ids.__getitem__, tokens), np.uint64, n)
    if n < k:
        k = n
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += _mix(w[j : n - k + 1 + j]) * _POWERS[j]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(occurrence > 0, _mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93)), h)


def sketch(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """For each table the PICKS shingles of the smallest hashes, hashed in their text order; and a byte of each in hash
    order, from which similarity is estimated."""
    m = min(PICKS, len(s))
    keys, marks = np.zeros(SKETCHES, np.int64), np.zeros((SKETCHES, PICKS), np.uint8)
    step = max(1, 65_536 // max(1, len(s)))
    for lo in range(0, SKETCHES, step):
        odd, add = _ODD[lo : lo + step, None], _ADD[lo : lo + step, None]
        h = s[None, :] * odd + add
        h ^= h >> np.uint64(32)
        pick = np.argpartition(h, m - 1, axis=1)[:, :m] if m < len(s) else np.tile(np.arange(m), (len(odd), 1))
        ranked = np.take_along_axis(pick, np.argsort(np.take_along_axis(h, pick, 1), axis=1), 1)
        marks[lo : lo + step, :m] = (s[ranked] >> np.uint64(40)).astype(np.uint8)
        x = np.full(len(odd), m, np.uint64)
        for row in s[np.sort(pick, axis=1)].T:
            x = _mix(x * np.uint64(0xBF58476D1CE4E5B9) + row)
        keys[lo : lo + step] = x.view(np.int64)
    return keys, marks.tobytes()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles aligned in order over all shingles: L / (|a| + |b| - L), L the longest common subsequence of the labelled
    shingles; 0 where it is below `least`. As labels make shingles unique, L is the longest increasing run of matched
    places; matches outside the band that `least` allows cannot lie on such an alignment and are left out."""
    n = len(a) + len(b)
    need = least / (1 + least) * n
    if not n or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < need - 1e-9:
        return 0.0
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    near = np.abs(ia - ib) <= n - 2 * need + 1e-9
    ib = ib[near]
    if len(ib) and (np.diff(ib) > 0).all():
        longest = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        longest = len(tails)
    found = longest / (n - longest)
    return found if found >= least - 1e-12 else 0.0


def _named(tokens: list[str]) -> tuple[int, int]:
    """128 bits of the words, as two longs."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest(" ".join(tokens).encode("utf-8", "replace"))
    return (digest >> 64) - (1 << 63), (digest & _MASK) - (1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, c1 and c2 (128 bits of its words), n (shingles), keys array<long>, marks binary."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2, n, keys, marks = [], [], [], [], []
            for value in b.column(1):
                tokens = (value.as_py() or "").split()
                x, y = _named(tokens)
                s = shingles(tokens)
                k, m = sketch(s) if len(s) else (np.zeros(0, np.int64), b"")
                c1.append(x), c2.append(y), n.append(len(s)), keys.append(k), marks.append(m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "c1", "c2", "n", "keys", "marks"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, c1 long, c2 long, n long, keys array<long>, marks binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ma, mb) to the pairs whose sketches' picks overlap by nearly half: pairs at 0.8 overlap by about
    0.78 +- 0.06. Texts of few shingles always pass."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), np.uint8).reshape(-1, SKETCHES, PICKS) for c in ("ma", "mb"))
            met = (x[:, :, :, None] == y[:, :, None, :]).any(3).mean((1, 2))
            few = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy()) < 3 * PICKS
            yield batch.select(["a", "b"]).filter(pa.array(few | (met >= 0.45)))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) to the pairs whose alignment reaches SIMILARITY."""
    for batch in batches:
        found = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) > 0 for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def _sequences(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> Saved:
    """(id, s): the shingles of the texts `wanted` (rep) as bytes. Documents are found by their id, texts among equal ids
    by their words."""
    texts = Saved(reps.join(wanted, "rep").select("rep", "doc_id", "c1", "c2"), "wanted")
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [(v.as_py() or "").split() for v in b.column(1)]
            names = [_named(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.array([shingles(t).tobytes() for t in tokens], pa.binary())], names=["c1", "c2", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = rows.join(small(texts.df.select("doc_id").distinct(), n, BROADCAST_ROWS), "doc_id", "left_semi").mapInArrow(run, "c1 long, c2 long, s binary")
    found = read.join(small(texts.df.drop("doc_id"), n, BROADCAST_ROWS), ["c1", "c2"]).select(F.col("rep").alias("id"), "s")
    out = Saved(found.dropDuplicates(["id"]), "sequences")
    texts.drop()
    return out


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose alignment reaches SIMILARITY. Only texts in pairs that lengths and sketches let
    through are read."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    fit = pairs.distinct().join(left, "a").join(right, "b").where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9)
    fit = Saved(fit.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_alike, "a long, b long"), "pairs")
    wanted = Saved(fit.df.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    seq = _sequences(docs, reps, wanted.df)
    both = fit.df.join(seq.df.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(seq.df.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = Saved(both.select("a", "b", "sa", "sb").mapInArrow(_aligned, "a long, b long"), "links")
    for t in (fit, wanted, seq):
        t.drop()
    return links.df


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Per row of the batch: its i and j, and the named fields of its list `rows` as arrays."""
    rows = batch.column("rows")
    at, fields = rows.offsets.to_numpy(), []
    for name in names:
        f = rows.values.field(name)
        if pa.types.is_list(f.type):
            fields.append(f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), -1))
        elif name == "marks":
            fields.append(np.frombuffer(b"".join(f.to_pylist()), np.uint8).reshape(-1, SKETCHES, PICKS))
        elif name == "s":
            fields.append([np.frombuffer(v, np.uint64) for v in f.to_pylist()])
        else:
            fields.append(f.to_numpy(zero_copy_only=False))
    for lo, hi, i, j in zip(at[:-1], at[1:], batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
        yield (i, j, *[f[lo:hi] for f in fields])


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block pairs (t, key, i, j, rows) to their texts that some text of another class may be linked with, by lengths and
    sketches. A pair counts in the first table that it meets in."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        tables, names = batch.column("t").to_pylist(), batch.column("key").to_pylist()
        for at, (i, j, rep, root, n, b, keys, marks) in enumerate(_lists(batch, "rep", "root", "n", "b", "keys", "marks")):
            fit = np.triu(root[:, None] != root[None, :], 1)
            fit &= np.minimum(n[:, None], n[None, :]) >= SIMILARITY * np.maximum(n[:, None], n[None, :]) - 1e-9
            if i != j:
                fit &= b[:, None] != b[None, :]
            x, y = np.nonzero(fit)
            alive = np.zeros(len(rep), bool)
            for lo in range(0, len(x), 4096):
                u, v = x[lo : lo + 4096], y[lo : lo + 4096]
                first = (keys[u, : tables[at]] != keys[v, : tables[at]]).all(1)
                u, v = u[first], v[first]
                met = (marks[u][:, :, :, None] == marks[v][:, :, None, :]).any(3).mean((1, 2))
                hope = (met >= 0.45) | (np.minimum(n[u], n[v]) < 3 * PICKS)
                alive[u[hope]] = alive[v[hope]] = True
            hit = np.flatnonzero(alive)
            for column, values in zip(out, ([tables[at]] * len(hit), [names[at]] * len(hit), [i] * len(hit), [j] * len(hit), b[hit].tolist(), rep[hit].tolist(), root[hit].tolist()), strict=True):
                column += values
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["t", "key", "i", "j", "b", "rep", "root"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block pairs (i, j, rows) to links (a, b) that join all their classes that links join: every pair of two classes
    is compared until links found before connect it, those of most shared shingles first."""
    for batch in batches:
        left, right = [], []
        for i, j, rep, root, b, s in _lists(batch, "rep", "root", "b", "s"):
            sizes = np.array([len(v) for v in s])
            if len(s) < 2:
                continue
            terms = np.unique(np.concatenate(s), return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            shared, there = np.zeros((len(s), len(s)), np.int64), np.zeros(terms.max() + 1, np.int64)
            for k in range(len(s)):
                own = terms[starts[k] : starts[k] + sizes[k]]
                there[own] = 1
                shared[k] = np.add.reduceat(there[terms], starts)
                there[own] = 0
            total = sizes[:, None] + sizes[None, :]
            # an alignment has at most the shared shingles
            fit = np.triu(shared >= SIMILARITY / (1 + SIMILARITY) * total - 1e-9, 1) & (root[:, None] != root[None, :])
            if i != j:
                fit &= b[:, None] != b[None, :]
            x, y = np.nonzero(fit)
            label = np.unique(root, return_inverse=True)[1]
            for k in np.argsort(-shared[x, y] / total[x, y], kind="stable").tolist():
                u, v = x[k], y[k]
                if label[u] != label[v] and similarity(s[u], s[v]) > 0:
                    label[label == label[v]] = label[u]
                    left.append(int(rep[u])), right.append(int(rep[v]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _across(docs: DataFrame, reps: DataFrame, buckets: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that join the classes left by `links` wherever two texts of a bucket are linked."""
    comp = Saved(components(links), "components")
    rooted = Saved(buckets.join(comp.df.withColumnRenamed("node", "rep"), "rep", "left").select("t", "key", "rep", "n", F.coalesce("component", "rep").alias("root")), "rooted")
    m = F.count(F.lit(1))
    blocks = F.ceil(F.least(m, F.greatest(m / block, F.sum("n") / BLOCK_SHINGLES))).cast("int").alias("blocks")
    mixed = Saved(rooted.df.groupBy("t", "key").agg(blocks, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t", "key", "blocks"), "mixed")
    placed = rooted.df.join(small(mixed.df, mixed.count()), ["t", "key"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.join(reps.select("rep", "keys", "marks"), "rep").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = ["t", "key", "i", "j"]
    placed = placed.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    lists = placed.groupBy(*pair).agg(F.collect_list(F.struct("rep", "root", "n", "b", "keys", "marks")).alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    left = Saved(lists.select(*pair, "rows").mapInArrow(_hopeful, "t int, key long, i int, j int, b int, rep long, root long"), "hopeful")
    wanted = Saved(left.df.select("rep").distinct(), "wanted")
    seq = _sequences(docs, reps, wanted.df)
    full = left.df.join(seq.df.select(F.col("id").alias("rep"), "s"), "rep").groupBy(*pair).agg(F.collect_list(F.struct("rep", "root", "b", "s")).alias("rows"))
    found = Saved(full.select("i", "j", "rows").mapInArrow(_joined, "a long, b long"), "links")
    for t in (comp, rooted, mixed, left, wanted, seq):
        t.drop()
    return found.df


def classes(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Saved]:
    """Per row of docs: doc_id, c1 and c2 (its words), n (shingles), class_id, and first: whether it may stand for its
    class (its text and id are the class's first); and the sketches' table, whose rows are docs'.

    Texts of the same words are one text with a number of its own, so copies meet no further and rows of one id may be
    different texts. Each text is compared with one centre: the smallest number that shares a bucket of equal sketches
    with it. Where texts of a bucket then belong to several classes, all pairs of texts of two classes are compared:
    as pairs of blocks of bounded size, each a row of its own, first by lengths and sketches, then, among texts left
    with a partner, by alignment. Block pairs give links that join classes, never all pairs. Classes are connected
    components over verified links, named by their smallest doc_id."""
    rows = Saved(sketches(docs), "sketches")
    named = rows.df.where("n > 0 and doc_id is not null")
    firsts = named.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "n", "keys", "marks")).alias("f"))
    number = F.monotonically_increasing_id().alias("rep")
    reps = Saved(firsts.select(number, "c1", "c2", F.col("f.doc_id").alias("doc_id"), F.col("f.n").alias("n"), F.col("f.keys").alias("keys"), F.col("f.marks").alias("marks")), "texts")
    exploded = reps.df.select("rep", "n", F.posexplode("keys").alias("t", "key"))
    shared = exploded.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("centre")).where("m > 1").drop("m")
    buckets = Saved(exploded.join(shared, ["t", "key"]), "buckets")
    star = buckets.df.groupBy("rep").agg(F.min("centre").alias("centre")).where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    links = _verified(docs, reps.df, star)
    links = links.unionByName(_across(docs, reps.df, buckets.df.drop("centre"), links, block))
    buckets.drop()
    comp = components(links).withColumnRenamed("node", "rep")
    joined = Saved(reps.df.select("c1", "c2", "rep", "doc_id").join(comp, "rep", "left").withColumn("cls", F.coalesce("component", "rep")).drop("component"), "joined")
    reps.drop()
    least = joined.df.groupBy("cls").agg(F.min(F.struct("doc_id", "rep")).alias("l"))
    final = Saved(joined.df.join(least, "cls").select("c1", "c2", F.col("l.doc_id").alias("cls"), (F.col("rep") == F.col("l.rep")).alias("first")), "classes")
    joined.drop()
    out = rows.df.select("doc_id", "c1", "c2", "n").join(final.df, ["c1", "c2"], "left")
    ok = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    class_id = F.when(ok, F.coalesce("cls", "doc_id")).otherwise(F.col("doc_id"))
    first = F.when(ok, F.coalesce(F.col("first") & (F.col("doc_id") == F.col("cls")), F.lit(True))).otherwise(F.lit(True))
    return out.select("doc_id", "c1", "c2", "n", class_id.alias("class_id"), first.alias("first")), rows


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id).

    Linked are texts whose five-word shingles, aligned in order, agree to 0.8 or more of their union; fewer than five
    words must be equal. Texts without words (null, empty, blank) and rows without an id link with nothing and are kept,
    class_id being their own id. Rows of one id may be different texts; each has its own text's class. An empty table
    gives no rows."""
    found, _ = classes(docs)
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return found.select("doc_id", "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with the same columns, less all rows but one of each class: a row of the smallest id. Rows of one id and
    different texts are judged each by its own text; rows of one id and the same words are one row; rows without an id
    all stay."""
    text_batches(docs.sparkSession)
    found, rows = classes(docs)
    id_, own, a, b, x, y = fresh(docs, "id", "own", "c1", "c2", "x", "y")
    known = Saved(found.where("doc_id is not null"), "known")
    times = known.df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("first").alias("first"))
    gone = Saved(times.where("m = 1 and not first").select(F.col("doc_id").alias(id_)), "gone")
    twice = Saved(times.where("m > 1").select(F.col("doc_id").alias(id_)), "twice")
    n_gone, n_twice = gone.count(), twice.count()
    key = F.col("doc_id").cast("long")
    rest = docs.join(small(gone.df, n_gone), key == F.col(id_), "left_anti")
    if not n_twice:
        return rest
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [_named((v.as_py() or "").split()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([u for u, _ in named], pa.int64()), pa.array([v for _, v in named], pa.int64())], names=[*batch.schema.names[:-1], a, b])

    many = docs.join(small(twice.df, n_twice), key == F.col(id_), "left_semi").withColumn(own, F.col(docs.columns[at]).cast("string"))
    many = many.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(a, T.LongType()), T.StructField(b, T.LongType())]))
    firsts = known.df.where("first").join(small(twice.df, n_twice), F.col("doc_id") == F.col(id_)).select(id_, F.col("c1").alias(x), F.col("c2").alias(y)).distinct()
    kept = many.join(firsts, (key == F.col(id_)) & (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_semi")
    once = rest.join(small(twice.df, n_twice), key == F.col(id_), "left_anti")
    return once.unionByName(kept.dropDuplicates(["doc_id", a, b]).drop(a, b))
