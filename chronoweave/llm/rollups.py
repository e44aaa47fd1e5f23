"""Token counts kept as signed deltas: additive totals by source, language and tokenizer version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, new_path

KEYS = ("source", "lang", "tokenizer")
_BLANK = r"\x20\x09-\x0D"
#: Patterns whose matches are counted: words; words with a letter or digit; letter runs, digit runs and single marks.
WORD, SPOKEN, PIECE = rf"[^{_BLANK}]+", rf"[\p{{L}}\p{{N}}][^{_BLANK}]*+", rf"\p{{L}}++|\p{{N}}++|[^{_BLANK}\p{{L}}\p{{N}}]"


def matches(text: Column, pattern: str) -> Column:
    """Matches of a linear pattern in the whole text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def signed(rows: DataFrame, sign: int, tokenizer: str, tokens: str) -> DataFrame:
    """rows (source, lang, a column of counts) as deltas: +1 to insert them, -1 to delete them. A revised count is the
    old rows with -1 and the new ones with +1."""
    one = F.lit(sign).cast("long")
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), one.alias("docs"), (one * F.col(tokens)).alias("tokens"))


class TokenRollup:
    """Totals under a path that all executors share.

    A batch is summed by key (combined before its shuffle; a source may hold most rows), written to a folder of its own,
    and published by creating the file commits/<batch>, which fails if it is there. So a batch counts once however often
    it is sent, an attempt that dies counts for nothing, and attempts of one batch that race count once. Readers see
    published batches only. Batches may come in any order, as deltas are added. Batch names are file names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _publish(self, name: str, what: dict) -> bool:
        """Creates the file with its content under another name and moves it into place, if none is there."""
        self._fs.mkdirs(self._at("commits"))
        waiting, place = self._at(f"waiting-{uuid.uuid4().hex}"), self._at("commits", name)
        out = self._fs.create(waiting, False)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        if not self._fs.exists(place) and self._fs.rename(waiting, place):
            return True
        self._fs.delete(waiting, False)
        return False

    def _published(self) -> dict[str, dict]:
        if not self._fs.exists(self._at("commits")):
            return {}
        out = {}
        for status in self._fs.listStatus(self._at("commits")):
            name = status.getPath().getName()
            if not name.endswith(".crc"):
                stream = self._fs.open(status.getPath())
                try:
                    out[name] = json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
        return out

    def committed(self) -> set[str]:
        found = self._published()
        return {b for n, c in found.items() for b in c.get("covers", [n])}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas (source, lang, tokenizer, docs, tokens); False if it was there already. Null keys are
        keys; null numbers count 0; an empty batch is a batch."""
        if batch in self.committed():
            return False
        folder = f"data/{uuid.uuid4().hex}"
        zero = F.lit(0).cast("long")
        summed = deltas.groupBy(*KEYS).agg(F.sum(F.coalesce("docs", zero)).alias("docs"), F.sum(F.coalesce("tokens", zero)).alias("tokens"))
        summed.write.parquet(f"{self.path}/{folder}")
        return self._publish(batch, {"folder": folder})

    def compact(self) -> None:
        """One folder for all batches published so far. The snapshot names what it covers, so a reader that finds it
        beside its batches leaves those out."""
        found = self._published()
        covers = sorted(self.committed())
        if len(found) < 2:
            return
        folder = f"data/{uuid.uuid4().hex}"
        self.totals(drop_zero=False).select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.parquet(f"{self.path}/{folder}")
        self._publish(f"snapshot-{uuid.uuid4().hex}", {"folder": folder, "covers": covers})

    def totals(self, *, drop_zero: bool = True) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the sums of all published deltas, keys without documents and tokens
        left out (drop_zero)."""
        found = self._published()
        snapshot = max((c for c in found.values() if "covers" in c), key=lambda c: len(c["covers"]), default=None)
        covered = set(snapshot["covers"]) if snapshot else set()
        folders = [c["folder"] for n, c in found.items() if "covers" not in c and n not in covered]
        folders += [snapshot["folder"]] if snapshot else []
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)) if drop_zero else out


def corpus_rollup(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after four batches over all rows of docs (doc_id, text, lang, source), each sent twice: load inserts every
    row with its word count (words-1); copies deletes all rows of equal texts but the one of the smallest id, source
    and language; recount revises words-1 to words with a letter or digit; pieces inserts the rest under pieces-2. Null
    texts count as empty, which is one text. An empty table gives no rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col("source").cast("string"), F.col("lang").cast("string"), matches(text, WORD).alias("words"), matches(text, SPOKEN).alias("spoken"), matches(text, PIECE).alias("pieces"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    counted = Saved(rows, "counted")
    first = counted.df.groupBy("h1", "h2").agg(F.min(F.struct("id", "source", "lang", "words", "spoken", "pieces")).alias("f"))
    kept = Saved(first.select("f.*"), "kept")
    store = TokenRollup(spark, path or new_path(spark, "rollup"))
    batches = {
        "load": signed(counted.df, 1, "words-1", "words"),
        "copies": signed(counted.df, -1, "words-1", "words").unionByName(signed(kept.df, 1, "words-1", "words")),
        "recount": signed(kept.df, -1, "words-1", "words").unionByName(signed(kept.df, 1, "words-1", "spoken")),
        "pieces": signed(kept.df, 1, "pieces-2", "pieces"),
    }
    for _ in range(2):
        for name, deltas in batches.items():
            store.commit(name, deltas)
    counted.drop(), kept.drop()
    return store.totals()
