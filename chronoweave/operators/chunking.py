"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import _let, strip
from ..functions.text import numbered

# Sentence ends, in the order in which they are tried.
SENTENCE_ENDS = (". ", "? ", "! ", "。", "？", "！")


def _finish(rows: DataFrame, strategy: str, token_count: Callable[[Column], Column]) -> DataFrame:
    return rows.select(numbered("doc_id", "chunk", "chunk_index").alias("chunk_id"), "content", "doc_id", "doc_title", "source_idx", F.col("chunk_index").cast("int"), F.col("start_char").cast("int"), F.col("end_char").cast("int"), F.lit(strategy).alias("strategy"), token_count(F.col("content")).cast("int").alias("token_count"), "metadata")


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, doc_title, source_idx, content and metadata, absent ones empty."""
    have = set(docs.columns)
    pick = lambda *names: next((F.col(n).cast("string") for n in names if n in have), F.lit(""))
    metadata = F.col("metadata") if "metadata" in have else F.create_map().cast("map<string,string>")
    return docs.select(pick("doc_id").alias("doc_id"), pick("doc_title", "title").alias("doc_title"), pick("source_idx").alias("source_idx"), F.coalesce(pick("content", "text"), F.lit("")).alias("body"), metadata.alias("metadata"))


def _piece(start: Column, end: Column, content: Column, tokens: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), content.alias("content"), tokens.cast("int").alias("n"))


def _tail_merged(pieces: Column, least: int, whole: Callable[[Column, Column], Column]) -> Column:
    """A last piece of fewer than `least` tokens (or characters, as n counts) goes into the one before: whole(a, b)."""

    def merged(p: Column) -> Column:
        a, b = F.element_at(p, -2), F.element_at(p, -1)
        return F.when((F.size(p) > 1) & (F.element_at(p, -1)["n"] < least), F.concat(F.slice(p, F.lit(1), F.size(p) - 2), F.array(whole(a, b)))).otherwise(p)

    return _let(F.filter(pieces, lambda x: x["content"] != ""), merged)


def _pieces(d: DataFrame, pieces: Column, strategy: str, token_count: Callable[[Column], Column]) -> DataFrame:
    """A row per piece, numbered in its document's row: no shuffle, and the text itself stays behind."""
    out = d.select("doc_id", "doc_title", "source_idx", "metadata", F.posexplode(pieces).alias("chunk_index", "c"))
    return _finish(out.select("*", F.col("c.s").alias("start_char"), F.col("c.e").alias("end_char"), F.col("c.content").alias("content")), strategy, token_count)


def by_chars(docs: DataFrame, *, size: int = 1500, overlap: int = 100, least: int = 500, token_count: Callable[[Column], Column] = F.length) -> DataFrame:
    """Windows of `size` code points that step back by `overlap`; blank ones are dropped before numbering; a short last
    one joins the one before, cut again from the text. Starts follow from the length alone, so a row's chunks are made
    within the row. Rows of one id are cut and numbered each by itself."""
    step, body = size - overlap, F.col("body")
    part = lambda a, z: strip(F.substring(body, a + 1, z - a))

    def windows(n: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

        def window(i: Column) -> Column:
            start, end = i * step, F.least(i * step + size, n)
            return _let(part(start, end), lambda text: _piece(start, end, text, F.length(text)))

        cut = F.transform(F.sequence(F.lit(0), last), window)
        whole = lambda a, b: _let(part(a["s"], b["e"]), lambda text: _piece(a["s"], b["e"], text, F.length(text)))
        return F.when(n <= size, F.array(_piece(F.lit(0), n, body, n))).otherwise(_tail_merged(cut, least, whole))

    return _pieces(_inputs(docs), _let(F.length("body"), windows), "fixed_size", token_count)


def by_tokens(docs: DataFrame, *, size: int = 1500, overlap: int = 100, least: int = 500, pattern: str = r"\s*\S+") -> DataFrame:
    """Windows of `size` tokens, a token being a match of `pattern` (white space and the word after it): the JVM's own
    tokens. For a model's tokens see by_model_tokens. A short last window joins the one before, overlap and all."""
    step, body = size - overlap, F.col("body")
    tokens = lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def windows(t: Column) -> Column:
        n = F.size(t)
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int"))
        joined = lambda i, k: F.array_join(F.slice(t, i * step + 1, F.lit(k)), "")

        def window(i: Column, gaps: Column) -> Column:
            start = F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, x: a + x)
            return _let(joined(i, size), lambda raw: _piece(start, start + F.length(raw), strip(raw), F.least(F.lit(size), n - i * step)))

        cut = _let(F.transform(places, lambda i: F.length(joined(i, step))), lambda gaps: F.transform(places, lambda i: window(i, gaps)))
        both = lambda a, b: F.concat_ws(" ", a["content"], b["content"])
        whole = lambda a, b: _let(both(a, b), lambda text: _piece(a["s"], b["e"], text, F.size(tokens(text))))
        return F.when(n <= size, F.array(_piece(F.lit(0), F.length(body), body, n))).otherwise(_tail_merged(cut, least, whole))

    return _pieces(_inputs(docs), _let(tokens(body), windows), "fixed_size", lambda _: F.col("c.n"))


_CUT = "doc_id string, doc_title string, source_idx string, metadata map<string,string>"


def _exploded(rows: DataFrame, strategy: str, token_count: Callable[[Column], Column]) -> DataFrame:
    """A row per element of cuts, with the document's metadata."""
    out = rows.select("doc_id", "doc_title", "source_idx", "metadata", F.posexplode("cuts").alias("chunk_index", "c"))
    return _finish(out.select("*", F.col("c.content").alias("content"), F.col("c.s").alias("start_char"), F.col("c.e").alias("end_char")), strategy, token_count)


def _per_document(docs: DataFrame, cut: Callable[[str], list[tuple[str, int, int, int]]], strategy: str) -> DataFrame:
    """cut: text to (content, start, end, tokens). For cuts that depend on the cut before them; one document at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(cuts=[[{"content": c, "s": s, "e": e, "n": n} for c, s, e, n in cut(body)] for body in frame["body"]])
            yield frame[["doc_id", "doc_title", "source_idx", "metadata", "cuts"]]

    return _exploded(_inputs(docs).mapInPandas(run, f"{_CUT}, cuts array<struct<content:string,s:int,e:int,n:int>>"), strategy, lambda _: F.col("c.n"))


def by_chars_at_sentences(docs: DataFrame, *, size: int = 1500, overlap: int = 100, least: int = 500) -> DataFrame:
    """As by_chars, but a window ends after the first sentence end found from its middle to 100 beyond it; the next
    start depends on that, so each document is cut in turn."""

    def cut(body: str) -> list[tuple[str, int, int, int]]:
        if len(body) <= size:
            return [(body, 0, len(body), len(body))]
        out: list[tuple[str, int, int, int]] = []
        start = end = 0
        while end < len(body):
            end = min(start + size, len(body))
            if end < len(body):
                low, window = start + size // 2, body[start + size // 2 : end + 100]
                hit = next((low + p + len(x) for x in SENTENCE_ENDS if (p := window.find(x)) >= 0), None)
                end = hit or end
            piece = body[start:end].strip()
            if piece:
                out.append((piece, start, end, len(piece)))
            back = end - overlap
            start = back if not out or back > out[-1][1] else end
        if len(out) > 1 and len(out[-1][0]) < least:
            whole = body[out[-2][1] : out[-1][2]].strip()
            out[-2:] = [(whole, out[-2][1], out[-1][2], len(whole))]
        return out

    return _per_document(docs, cut, "fixed_size")


def by_model_tokens(docs: DataFrame, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], *, size: int = 1500, overlap: int = 100, least: int = 500) -> DataFrame:
    """Windows of a tokenizer's ids; offsets are summed over decoded tokens, in one pass."""

    def cut(body: str) -> list[tuple[str, int, int, int]]:
        ids = encode(body)
        if len(ids) <= size:
            return [(body, 0, len(body), len(ids))]
        ends = [0]
        for k in range(0, len(ids), 64):
            base = ends[-1]
            ends += [base + len(decode(ids[k : k + j + 1])) for j in range(min(64, len(ids) - k))]
        out: list[tuple[str, int, int, int]] = []
        for start in range(0, max(1, len(ids) - overlap), size - overlap):
            part = ids[start : start + size]
            piece = decode(part).strip()
            if piece:
                out.append((piece, ends[start], ends[start + len(part)], len(part)))
        if len(out) > 1 and out[-1][3] < least:
            whole = f"{out[-2][0]} {out[-1][0]}"
            out[-2:] = [(whole, out[-2][1], out[-1][2], len(encode(whole)))]
        return out

    return _per_document(docs, cut, "fixed_size")


def split_sentences(text: Column) -> Column:
    """After a full stop, question or exclamation mark before white space or a capital; a long text that stays whole is
    split after each mark."""
    clean = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    again = lambda first: F.when((F.size(first) <= 1) & (F.length(text) > 100), clean(F.split(text, r"(?<=[.!?。！？])\s*"))).otherwise(first)
    return _let(clean(F.split(text, r"(?<=[.!?。！？])\s+|(?<=[.!?。！？])(?=[A-Z])")), again)


def merge_short(sentences: Column, least: int = 3) -> Column:
    """Sentences of `least` characters or fewer go to the one before."""
    grow = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), x)))
    return F.aggregate(sentences, F.array().cast("array<string>"), lambda acc, x: F.when((F.length(x) <= least) & (F.size(acc) > 0), grow(acc, x)).otherwise(F.concat(acc, F.array(x))))


def by_sentences(docs: DataFrame, *, most: int = 10, overlap: int = 2, least: int = 500, largest: int = 2000) -> DataFrame:
    """Sentences packed until there are `most` or they would pass `largest` characters; the next chunk begins with the
    last `overlap` of them. A short last chunk joins the one before if both stay within 1.5 times `largest`. Sentences
    are split by the JVM; the packing follows them one by one, per document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cuts=[_pack(body, list(s), most, overlap, least, largest) for body, s in zip(frame["body"], frame["s"], strict=True)])[["doc_id", "doc_title", "source_idx", "metadata", "cuts"]]

    rows = _inputs(docs).withColumn("s", merge_short(split_sentences(F.col("body"))))
    return _exploded(rows.mapInPandas(run, f"{_CUT}, cuts array<struct<content:string,s:int,e:int>>"), "sentence", F.length)


def _pack(body: str, sentences: list[str], most: int, overlap: int, least: int, largest: int) -> list[dict]:
    out: list[dict] = []
    held: list[str] = []
    start = at = 0
    for k, s in enumerate(sentences):
        here = body.find(s, at)
        here = at if here < 0 else here
        length = sum(map(len, held)) + len(held) + len(s)
        if held and (len(held) >= most or length > largest):
            out.append({"content": " ".join(held), "s": start, "e": here})
            back = sentences[max(0, k - overlap) : k] if overlap > 0 else []
            held, start = [*back, s], here - sum(len(x) + 1 for x in back)
        else:
            held.append(s)
        at = here + len(s)
    if held:
        tail = " ".join(held)
        if out and len(tail) < least and len(out[-1]["content"]) + 1 + len(tail) <= largest * 1.5:
            out[-1] = {"content": f"{out[-1]['content']} {tail}", "s": out[-1]["s"], "e": len(body)}
        else:
            out.append({"content": tail, "s": start, "e": len(body)})
    return out


def chunk(docs: DataFrame, strategy: str = "fixed_size", *, unit: str = "chars", preserve_sentences: bool = False, **options) -> DataFrame:
    """By strategy: fixed_size over chars or tokens, or sentence."""
    if strategy == "sentence":
        return by_sentences(docs, **options)
    if strategy != "fixed_size":
        raise ValueError(f"no such strategy: {strategy}")
    if unit == "tokens":
        return by_tokens(docs, **options)
    return (by_chars_at_sentences if preserve_sentences else by_chars)(docs, **options)
