"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

#: Unicode's White_Space property: what \\s means in the tokenizer's pattern (Python's \\s has more).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: After so many code points a text is cut at the next safe boundary.
PART_CHARS = 16_384
#: A part that stays longer than this has no safe boundary: it is one long run, whose matches are found one by one.
LONG_CHARS = 131_072

_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LEAD = re.compile(f"[{WHITE}]*")
_codecs: dict = {}


def load_ranks(path: str) -> bytes:
    """The rank file as it is; under a megabyte, so it may be sent to every executor."""
    with open(path, "rb") as f:
        return f.read()


def codec(ranks: bytes, pattern: str):
    """tiktoken's encoding for these ranks, built once in each Python worker."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _codecs:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _codecs[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _codecs[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts that encode as the whole text does. Cuts lie only between a character and white space after it: no match
    of the pattern crosses such a place (white space can only begin a match there), and the only look-ahead reads past
    white space, which a part never ends with, unless the text does."""
    at, n = 0, len(text)
    while n - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str, pattern: str) -> list[int]:
    """The ids of a whole text, without special tokens."""
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text):
        ids += enc.encode_ordinary(part) if len(part) <= LONG_CHARS else _encode_run(enc, part, pattern)
    return ids


def _encode_run(enc, part: str, pattern: str) -> list[int]:
    """A part that may be one enormous run: white space is split by hand (tiktoken's matcher would run out of its
    backtracking steps on it), the rest by a linear matcher; each match is merged on its own."""
    import regex

    lead = _LEAD.match(part).end()
    pieces: list[str] = []
    if lead == len(part):
        pieces.append(part)
    else:
        if lead > 1:
            pieces.append(part[: lead - 1])  # all but the last white space, as \\s+(?!\\S) takes it
        lead = max(0, lead - 1)
    if lead < len(part):
        # this matcher's \\s has characters that tiktoken's has not
        same = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        pieces += (m[0] for m in regex.finditer(same, part[lead:]))
    ids: list[int] = []
    for piece in pieces:
        ids += enc._encode_single_piece(piece) if piece else []
    return ids


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of the ids; a cut inside a character is no error."""
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, with_ids: bool = True, with_digests: bool = True) -> DataFrame:
    """Encodes column text of every row of docs (doc_id, text, any others) and decodes it again.

    Returns doc_id, n_tokens, and as asked: ids array<int>, decoded string-bytes (with_ids); ids_sha256 and
    decoded_sha256 (with_digests). A null text counts as empty: 0 tokens, digests of nothing. Texts of any length are
    encoded whole; doc_id may be null or repeated: each row gives one row. No shuffle; a worker holds one batch."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(load_ranks(rank_file))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if with_digests else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(sent.value, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(fields) - 1)]
            for value in batch.column(1):
                ids = encode(enc, value.as_py() or "", pattern)
                raw = decode(enc, ids)
                row: list = [len(ids)]
                row += [ids, raw] if with_ids else []
                row += [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()] if with_digests else []
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    types = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    ddl = ", ".join(f"{f.name} {types[f.name]}" for f in schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def public_rank_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
