"""The corpus operators' queries, applied with production parameters to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosspoly, itq, linesuffix, mixing, omh, pii, quality, rollups, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.public_rank_file()
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, pattern, with_ids=False)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linesuffix.report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_copies(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_vectors, op2_token_rollup, op3_bpe, op4_url_filter, op5_neighbours, op6_pii, op7_mixing, op8_line_dedup, op9_quality, op10_near_copies)}


_HOST = r"translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The test pages have neither redirects nor canonical links, so the rules alone give the verdicts; the checks that links
#: carry blocks are in the tests.
OP4 = f"""
with p as (select page_id, coalesce({_HOST}, '') as host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules(verdict, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (select page_id, host, path, r.verdict, rhost || rpath as rule, row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc) as place
  from p left join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, false as aliased from fits where place = 1
"""


OP2 = r"""
with c as (select doc_id, source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w, len(regexp_extract_all(t, '[\p{L}\p{N}][^\x20\x09-\x0D]*')) as spoken,
    len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) as pieces, row_number() over (partition by t order by doc_id, source, lang) as place
  from (select *, coalesce(text, '') as t from documents)),
k as (select * from c where place = 1)
select source, lang, 'words-1' as tokenizer, count(*) as n_docs, sum(spoken)::bigint as n_tokens from k group by all
union all select source, lang, 'pieces-2', count(*), sum(pieces)::bigint from k group by all
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_token_rollup": OP2, "op4_url_filter": OP4}
