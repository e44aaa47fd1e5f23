"""Keyword search over a table of nodes (node_id, ord, text): TF-IDF, BM25 and plain matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def query_terms(spark: SparkSession, query: str, **options) -> DataFrame:
    """term, qtf: one row; as few as the query's words, so the query joins as the broadcast side by its size."""
    one = spark.range(1).select(tokens(F.lit(query), **options).alias("t"))
    return one.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))


@dataclass
class Index:
    """tokens (node_id, ord, t): each node's terms in their order; may be saved and read again as a table."""

    tokens: DataFrame

    @property
    def postings(self) -> DataFrame:
        """node_id, ord, term, tf; combined before the shuffle."""
        terms = self.tokens.select("node_id", "ord", F.explode("t").alias("term"))
        return terms.groupBy("node_id", "ord", "term").agg(F.count(F.lit(1)).alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        return self.tokens.select("node_id", "ord", F.size("t").alias("dl"))

    @property
    def counted(self) -> DataFrame:
        """term, v, kind: in one pass how many nodes have each term (kind 0), how many nodes there are (1, no term) and how
        long they are together (2, empty term). A node gives each of its terms once, so the shuffle has combined counts.
        Kind is an aggregate, so that filters on it stay above the shuffle and all readers share it."""
        row = lambda term, v, kind: F.struct(term.cast("string").alias("term"), v.cast("long").alias("v"), F.lit(kind).alias("kind"))
        whole = F.array(row(F.lit(None), F.lit(1), 1), row(F.lit(""), F.size("t"), 2))
        each = F.transform(F.array_distinct("t"), lambda x: row(x, F.lit(1), 0))
        rows = self.tokens.select(F.explode(F.concat(whole, each)).alias("x")).select("x.*")
        return rows.groupBy("term").agg(F.sum("v").alias("v"), F.max("kind").alias("kind"))

    @property
    def stats(self) -> DataFrame:
        of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
        return self.counted.where("kind > 0").agg(of(1).alias("n"), (of(2) / of(1)).alias("avgdl"))

    @property
    def frequencies(self) -> DataFrame:
        return self.counted.where("kind = 0").select("term", F.col("v").alias("df"))

    def save(self, path: str) -> None:
        self.tokens.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(path))


def build(nodes: DataFrame, *, text: str = "text", **options) -> Index:
    return Index(nodes.select("node_id", "ord", tokens(text, **options).alias("t")))


def bm25(index: Index, query: DataFrame, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """node_id, ord, score for every node, also those that score 0 or less. A negative idf becomes epsilon times the
    mean idf of all terms. One pass counts terms; another scores each node within its row from the query's weights, one
    row that is broadcast (as many weights as the query has words)."""
    n = index.stats
    idf0 = index.frequencies.crossJoin(F.broadcast(n)).select("term", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf0"))
    floor = idf0.agg((F.avg("idf0") * epsilon).alias("low"))
    idf = F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(F.col("low"))
    weights = idf0.join(F.broadcast(query), "term").crossJoin(F.broadcast(floor)).select("term", (F.col("qtf") * idf).alias("w"))
    one = weights.agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("q")).crossJoin(F.broadcast(n))
    hits = F.filter("t", lambda x: F.array_contains(F.col("q.term"), x))
    scored = index.tokens.crossJoin(F.broadcast(one)).select("node_id", "ord", "q", "avgdl", F.size("t").alias("dl"), hits.alias("h"))

    def part(q: Column) -> Column:
        tf = F.size(F.filter("h", lambda x: x == q["term"]))
        return F.when(tf > 0, q["w"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    score = F.when(F.size("h") > 0, F.aggregate("q", F.lit(0.0), lambda s, q: s + part(q))).otherwise(0.0)
    return scored.select("node_id", "ord", score.alias("score"))


def tfidf(index: Index, query: DataFrame) -> DataFrame:
    """node_id, ord, score > 0: cosine of augmented tf times smoothed idf. The largest tf of a node divides its weights
    and its norm alike, so it falls out of the cosine."""
    idf = index.frequencies.crossJoin(F.broadcast(index.stats)).select("term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    # the largest count is over all the query's terms, known to the corpus or not
    most = query.agg(F.max("qtf").alias("qmost"))
    q = idf.join(F.broadcast(query), "term").crossJoin(F.broadcast(most)).select("term", (F.col("qtf") / F.col("qmost") * F.col("idf")).alias("qw"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    terms = idf.join(F.broadcast(q), "term", "left").select("term", "idf", F.coalesce("qw", F.lit(0.0)).alias("qw"))
    w = F.col("tf") * F.col("idf")
    sums = index.postings.join(terms, "term").groupBy("node_id", "ord").agg(F.sum(w * w).alias("norm"), F.sum(w * F.col("qw")).alias("dot")).where("dot > 0")
    return sums.crossJoin(F.broadcast(qnorm)).select("node_id", "ord", (F.col("dot") / (F.sqrt("norm") * F.col("qnorm"))).alias("score")).where("score > 0")


def match_score(text: Column, query: str, *, fuzzy: bool = True, case_sensitive: bool = False, least: int = 2) -> Column:
    """1 if the whole query is in the text; half the share of its tokens that are tokens of the text; 0.1 for each token,
    of `least` characters or more, that is anywhere in it (fuzzy)."""
    low = text if case_sensitive else F.lower(text)
    q = F.lit(query if case_sensitive else query.lower())
    qt, tt = F.array_distinct(tokens(F.lit(query), least=1)), F.array_distinct(tokens(text, least=1))
    whole = F.when(low.contains(q), 1.0).otherwise(0.0)
    share = F.when(F.size(qt) > 0, 0.5 * F.size(F.array_intersect(qt, tt)) / F.size(qt)).otherwise(0.0)
    parts = F.size(F.filter(qt, lambda x: (F.length(x) >= least) & low.contains(x))) * 0.1 if fuzzy else F.lit(0.0)
    return whole + share + parts


def simple_match(nodes: DataFrame, query: str, **options) -> DataFrame:
    return nodes.select("node_id", "ord", match_score(F.col("text"), query, **options).alias("score")).where("score > 0")


def search(nodes: DataFrame, query: str, *, algorithm: str = "bm25", index: Index | None = None, **options) -> DataFrame:
    """bm25, tfidf or match over one table of nodes."""
    if algorithm == "match":
        return simple_match(nodes, query, **options)
    index = index or build(nodes)
    q = query_terms(nodes.sparkSession, query)
    if algorithm == "tfidf":
        return tfidf(index, q)
    if algorithm == "bm25":
        return bm25(index, q, **options)
    raise ValueError(f"no such algorithm: {algorithm}")
