"""Mixing sources to target weights by Sainte-Lague apportionment of equal word blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, fresh, small

#: Weights of the sources in code point order, null last, over and over.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix has this share of all words; no source gives more than MAX_EPOCHS times its own.
SHARE, MAX_EPOCHS = 1.5, 2.0
#: Words in a block, and documents in a shard (about).
BLOCK_WORDS, SHARD_DOCS = 8, 1_000


def words(text):
    """Runs of characters other than space and \\t \\n \\v \\f \\r; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: one row per source (source, source_size, n_docs). Adds weight and target: share times all words, split by
    weight, stopped at epochs times the source's size, the excess split again until no target is above. The water
    level is found in one pass over the sources in the order of size per weight. Sources are few next to rows; the
    windows run over one row each."""
    one = F.lit(0)
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(epochs))
    by_ratio = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(one)
    total = F.sum("source_size").over(whole) * F.lit(share)
    left_words = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left_words / left_weight)
    # the first source, in this order, whose cap is above the level sets it for itself and all after it
    free = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * free["level"], F.col("cap")))).drop("cap", "level")


def apportion(rows: DataFrame, within: list[str], share, seats, tie: list) -> DataFrame:
    """Adds quota: seats of every group (columns `within`; none: all rows) dealt by Sainte-Lague, that is to the highest
    quotients share / (2 k + 1). Only quotients near each row's proportional part are listed: rounding shifts a group of
    n rows by at most n / 2 seats, which fall in proportion, so the list has about 3 n rows a group. Rows without a
    share get none."""
    keys = [F.lit(0)] if not within else [F.col(c) for c in within]
    whole = Window.partitionBy(*keys)
    a = rows.withColumn("_v", share.cast("double")).withColumn("_seats", seats.cast("long"))
    a = a.withColumn("_all", F.sum("_v").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    part = F.when(F.col("_all") > 0, F.col("_v") / F.col("_all")).otherwise(F.lit(0.0))
    a = a.withColumn("_near", F.floor(part * F.col("_seats") + 0.5)).withColumn("_reach", F.ceil(part * F.col("_n") / 2) + 2)
    a = a.withColumn("_base", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.col("_near") - F.col("_reach"))).otherwise(F.lit(0)))
    a = a.withColumn("_open", F.col("_seats") - F.sum("_base").over(whole)).withColumn("_row", F.row_number().over(whole.orderBy(*tie)))
    listed = a.where("_v > 0").select("*", F.explode(F.sequence(F.col("_base"), F.col("_near") + F.col("_reach"))).alias("_k"))
    quotient = F.col("_v") / (2 * F.col("_k") + 1)
    ranked = listed.withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), "_row", "_k")))
    won = ranked.where("_rank <= _open").groupBy(*within, "_row").agg(F.count(F.lit(1)).alias("_won"))
    on = F.lit(True)
    for c in [*within, "_row"]:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"w.{c}"))
    got = a.alias("a").join(won.alias("w"), on, "left").select("a.*", F.col("w._won"))
    return got.withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_v", "_seats", "_all", "_n", "_near", "_reach", "_base", "_open", "_row", "_won")


def plan_mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, epochs: float = MAX_EPOCHS, block: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = 0) -> DataFrame:
    """How many words of every row of docs (doc_id, text, source) the mix takes.

    Sources get word blocks by Sainte-Lague on their targets; a source's blocks are dealt the same way to its shards
    (rows by salted hash, so one hot source fills many shards, each of about shard_docs rows) in proportion to their
    words. A shard's rows lie in seeded order on a ring of its words; its quota of blocks, laid end to end from a
    seeded block, takes the whole ring as often as it fits and then one arc. So shard totals are exact to the block, no
    row is taken more than `epochs` times, and the plan never lists blocks as rows.

    Returns doc_id, source, size, source_size, target, taken, and the arc's part of the row: arc_from (words
    before it within the row; the arc wraps to the row's start if that is needed, see arc_wrap), arc_words, rounds.
    Null text: size 0, taken 0. Null source: a source of its own, last. Repeated rows are rows of their own; rows alike
    in id, source and text are interchangeable. An empty table gives no rows. Broadcasts the sources' and shards'
    tables only where their counted rows are few."""
    slim = Saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("th")), "sizes")
    sizes = slim.df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aimed = targets(sizes, weights, share, epochs).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5)
    dealt = apportion(aimed, [], F.col("target"), seats, [F.col("source").asc_nulls_last()])
    sources = Saved(dealt.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs)), "sources")
    n_sources = sources.count()
    keyed = slim.df.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    rows = keyed.join(small(sources.df.select("key", "shards"), n_sources), "key")
    rows = rows.withColumn("place", F.xxhash64("doc_id", "th", F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("place", F.lit(1)), F.col("shards"))).drop("shards")
    shards = rows.groupBy("key", "shard").agg(F.sum("size").alias("ring"))
    shards = shards.join(small(sources.df.select("key", F.col("quota").alias("source_quota"), "source", "source_size", "target"), n_sources), "key")
    shards = Saved(apportion(shards, ["key"], F.col("ring"), F.col("source_quota"), [F.col("shard")]), "shards")
    n_shards = shards.count()
    take = F.least(F.col("quota") * block, (F.col("ring") * F.lit(epochs)).cast("long"))
    whole = F.when(F.col("ring") > 0, F.expr("_take div ring")).otherwise(F.lit(0))
    first = F.when(F.col("ring") > 0, F.pmod(F.xxhash64("key", "shard", F.lit(seed), F.lit(2)), F.greatest(F.lit(1), F.expr(f"ring div {block}"))) * block).otherwise(F.lit(0))
    known = shards.df.withColumn("_take", take).withColumn("rounds", whole).withColumn("arc", F.col("_take") - F.col("rounds") * F.col("ring")).withColumn("first", first)
    line = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size", "th")
    laid = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    laid = laid.join(small(known.drop("quota", "source_quota", "_take"), n_shards), ["key", "shard"])
    # the arc covers [first, first + arc) and, where that passes the ring's end, [0, first + arc - ring)
    head = F.greatest(F.lit(0), F.least("end", F.col("first") + F.col("arc") - F.col("ring")) - F.col("start"))
    tail = F.greatest(F.lit(0), F.least(F.col("end"), F.col("first") + F.col("arc")) - F.greatest("start", "first"))
    laid = laid.withColumn("arc_head", F.when(F.col("arc") > 0, head).otherwise(F.lit(0))).withColumn("arc_tail", F.when(F.col("arc") > 0, tail).otherwise(F.lit(0)))
    laid = laid.withColumn("tail_from", F.greatest(F.lit(0), F.col("first") - F.col("start")))
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("arc_head") + F.col("arc_tail")).alias("taken"), "rounds", "arc_head", "tail_from", "arc_tail", "th")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of docs: a row as often as the mix takes it whole, and a row with the
    words of the arc where it ends inside a document (cut between words; white space inside is kept). Rows of no words
    stay once: there is nothing to take from them, and nothing to drop. Rows alike in id, source and text are told
    apart by their other columns, so reruns agree."""
    plan = plan_mix(docs, **options)
    keys = ["id", "origin", "th", "nth"]
    names = fresh(docs, *keys, "size", "rounds", "arc_head", "tail_from", "arc_tail", "piece")
    id_, origin, th, nth, size_, rounds, head, tail_from, tail, piece = names
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "source", "text")]
    same = Window.partitionBy(id_, origin, th)
    own = [F.col("doc_id").cast("long").alias(id_), F.col("source").cast("string").alias(origin), F.xxhash64(F.col("text").cast("string")).alias(th)]
    left = docs.select("*", *own).withColumn(nth, F.row_number().over(same.orderBy(F.to_json(F.struct(*rest)) if rest else F.lit(0))))
    taken = [F.col(c).alias(n) for c, n in zip(("size", "rounds", "arc_head", "tail_from", "arc_tail"), names[4:9], strict=True)]
    right = plan.select(F.col("doc_id").alias(id_), F.col("source").alias(origin), F.col("th").alias(th), *taken)
    right = right.withColumn(nth, F.row_number().over(same.orderBy(F.col(rounds), F.col(head), F.col(tail), F.col(tail_from))))
    on = F.lit(True)
    for c in (id_, origin, th, nth):
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in names[4:9]])
    size, arc = F.col(size_), F.col(head) + F.col(tail)
    whole = F.when(size == 0, F.lit(1)).otherwise(F.col(rounds) + F.when(arc >= size, F.lit(1)).otherwise(F.lit(0)))
    part = (size > 0) & (arc < size)
    item = lambda a, n: F.struct(a.cast("long").alias("from"), n.cast("long").alias("n"))
    none = F.array(item(F.lit(0), F.lit(0)))
    pieces = F.concat(
        F.array_repeat(item(F.lit(-1), F.lit(0)), whole.cast("int")),
        F.when(part & (F.col(head) > 0), F.array(item(F.lit(0), F.col(head)))).otherwise(F.slice(none, 1, 0)),
        F.when(part & (F.col(tail) > 0), F.array(item(F.col(tail_from), F.col(tail)))).otherwise(F.slice(none, 1, 0)),
    )
    out = both.withColumn(piece, F.explode(pieces))
    # words kept with the white space after each, so that joining a slice restores the text between them
    tokens = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    first, n = F.col(f"{piece}.from"), F.col(f"{piece}.n")
    cut = F.regexp_replace(F.array_join(F.slice(tokens, (first + 1).cast("int"), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(first < 0, F.col("text").cast("string")).otherwise(cut)
    return out.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
