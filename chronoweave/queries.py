"""Queries of the library's operators over the test tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bridge as B
from .functions import temporal as T
from .functions import text as X
from .functions import vector as V
from .operators import chunking, cluster, dedupe, graph, keyword, provenance, relations, semantic, timeline, validate, voting
from .operators import ranking as R
from .plans import providers, questions

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# SQL that several share
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{Mn}}_]+'), lambda x: length(x) >= 2)"
_POST = f"toks as (select doc_id, unnest({_TOKENS.format('text')}) as term from documents), post as (select doc_id, term, count(*) as tf from toks group by all), len as (select doc_id, len({_TOKENS.format('text')}) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from len), df as (select term, count(*) as df from post group by term), q as (select term, count(*) as qtf from (select unnest({_TOKENS.format(repr(B.QUERY))}) as term) group by term)"
_BM25 = f"{_POST}, idf0 as (select term, ln(n - df + 0.5) - ln(df + 0.5) as i from df, st), idf as (select term, qtf, case when i >= 0 then i else (select avg(i) * 0.25 from idf0) end as idf from idf0 join q using (term)), bm as (select l.doc_id, round(coalesce(s, 0), 6) as score from len l left join (select doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from post join idf using (term) join len using (doc_id), st group by doc_id) x on x.doc_id = l.doc_id)"
_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"
_NORMS = "sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))"
_COS = f"cs as (select a.vec_id, a.label, round({_DOT} / ({_NORMS}), 6) as score from embeddings a, embeddings b where b.vec_id = 0)"
_GRAIN = "case when event_id % 3 = 0 then strftime({0}, '%Y') when event_id % 3 = 1 then strftime({0}, '%Y-%m') else strftime({0}, '%Y-%m-%d') end"
_TEV = f"tev as (select event_id, user_id, event_type, w, {_GRAIN.format('w')} as time_start, case when event_id % 2 = 0 then {_GRAIN.format('(w + interval 7 day)')} end as time_end, case when event_id % 2 = 0 then 'range' else 'point' end as time_type from (select *, ts + to_days((event_id % 1500)::int) as w from events)), tl as (select user_id, event_type, 'user' || user_id || '/' || event_type as timeline_id, min(event_id) as first from tev group by all having count(*) >= 2), pos as (select event_id, timeline_id, row_number() over (partition by user_id, event_type order by w, event_id) - 1 as position from tev join tl using (user_id, event_type))"
_PARTS = "try_cast(substr({0}, 1, 4) as int) as y, try_cast(nullif(substr({0}, 6, 2), '') as int) as m, try_cast(nullif(substr({0}, 9, 2), '') as int) as d"

# Chunks

_CUT = f"""with n as (select doc_id, text, length(text) as n, greatest(0, ceil((length(text) - 1500) / 1400.0))::int as last from documents),
c as (select doc_id, n, i, i * 1400 as s, least(i * 1400 + 1500, n) as e, case when n <= 1500 then text else trim(text[i * 1400 + 1 : least(i * 1400 + 1500, n)], {_WS}) end as content, text from n, unnest(range(0, last + 1)) as u(i)),
k as (select *, row_number() over (partition by doc_id order by i) - 1 as idx from c where content <> '' or n <= 1500),
m as (select *, lead(e) over w as ne, lead(length(content)) over w as nl, lead(idx, 2) over w as after, lag(idx) over w as before from k window w as (partition by doc_id order by idx)),
"""


@query(_CUT + f"""r as (select doc_id, idx, s, case when ne is not null and after is null and nl < 500 then ne else e end as e, case when ne is not null and after is null and nl < 500 then trim(text[s + 1 : ne], {_WS}) else content end as content from m where not (ne is null and before is not null and length(content) < 500))
select doc_id::varchar || '-chunk-' || lpad(idx::varchar, 4, '0') as chunk_id, s::int as start_char, e::int as end_char, length(content)::int as token_count, md5(content) as digest from r""")
def q_chunk_fixed_char(spark, d):
    out = chunking.by_chars(B.documents(spark, d))
    return out.select("chunk_id", "start_char", "end_char", "token_count", F.md5("content").alias("digest"))


@query(r"""with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\x09-\x0D\x20]*[^\x09-\x0D\x20]+') as t from documents),
    n as (select *, len(t) as n, greatest(0, ceil((len(t) - 200) / 150.0))::int as last from t), c as (select *, n - last * 150 as tail from n, unnest(range(0, last + 1)) as u(i))
select doc_id::varchar || '-chunk-' || lpad(i::varchar, 4, '0') as chunk_id, case when last > 0 and tail < 100 and i = last - 1 then 200 + tail else least(200, n - i * 150) end::int as token_count,
    coalesce(length(array_to_string(t[1 : i * 150], '')), 0)::int as start_char from c where not (last > 0 and tail < 100 and i = last)""")
def q_chunk_fixed_token(spark, d):
    return chunking.by_tokens(B.documents(spark, d), size=200, overlap=50, least=100).select("chunk_id", "token_count", "start_char")


_PARTED = f"list_filter(list_transform(string_split({{}}, '␞'), lambda x: trim(x, {_WS})), lambda x: x <> '')"
_FIRST = _PARTED.format(r"regexp_replace(regexp_replace(text, '([.!?。！？])[\x09-\x0D\x20]+', '\1␞', 'g'), '([.!?。！？])([A-Z])', '\1␞\2', 'g')")
_AGAIN = _PARTED.format(r"regexp_replace(text, '([.!?。！？])[\x09-\x0D\x20]*', '\1␞', 'g')")


@query(f"""with p as (select doc_id, text, {_FIRST} as a, {_AGAIN} as b from documents), s as (select doc_id, case when len(a) <= 1 and length(text) > 100 then b else a end as s from p)
select doc_id, len(s)::int as n_sentences, md5(array_to_string(s, '|')) as digest from s""")
def q_sentence_split(spark, d):
    s = B.documents(spark, d).select("doc_id", chunking.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query()
def q_sentence_chunks(spark, d):
    return chunking.by_sentences(B.documents(spark, d)).select("chunk_id", "start_char", "end_char", F.md5("content").alias("digest"))


@query()
def q_chunk_sentence_cuts(spark, d):
    return chunking.by_chars_at_sentences(B.documents(spark, d)).select("chunk_id", "start_char", "end_char", F.md5("content").alias("digest"))


# Keywords


@query(f"select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {_TOKENS.format('text')} as t from documents)")
def q_tokens(spark, d):
    t = X.tokens("text")
    return B.documents(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"with {_POST} select term, df, max(tf) as most, sum(tf)::bigint as total from post join df using (term) group by all")
def q_corpus_stats(spark, d):
    p = keyword.build(B.nodes(spark, d)).postings
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most"), F.sum("tf").alias("total"))


def _bm25(spark, d):
    n = B.nodes(spark, d)
    return keyword.bm25(keyword.build(n), keyword.query_terms(spark, B.QUERY)).withColumn("score", F.round("score", 6))


@query(f"with {_BM25} select doc_id as node_id, score from bm order by score desc, doc_id limit 10")
def q_bm25_topk(spark, d):
    return R.top_k(_bm25(spark, d), 10).select("node_id", "score")


@query(f"with {_BM25} select doc_id as node_id, score from bm")
def q_bm25_all(spark, d):
    return _bm25(spark, d).select("node_id", "score")


@query(f"""with {_POST}, idf as (select term, ln((n + 1) / (df + 1)) + 1 as idf from df, st), w as (select doc_id, term, tf / max(tf) over (partition by doc_id) * idf as w from post join idf using (term)), nm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id), qw as (select term, qtf / (select max(qtf) from q) * idf as qw from q join idf using (term))
select doc_id as node_id, round(sum(w * qw) / (any_value(norm) * (select sqrt(sum(qw * qw)) from qw)), 6) as score from w join qw using (term) join nm using (doc_id) group by doc_id order by score desc, doc_id limit 10""")
def q_tfidf_topk(spark, d):
    n = B.nodes(spark, d)
    scored = keyword.tfidf(keyword.build(n), keyword.query_terms(spark, B.QUERY)).withColumn("score", F.round("score", 6))
    return R.top_k(scored, 10).select("node_id", "score")


@query(r"""with t as (select doc_id, lower(text) as l, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Mn}_]+')) as tt, ['the', 'theron', 'of'] as qt from documents)
select doc_id as node_id, round(case when contains(l, 'the theron of') then 1.0 else 0.0 end + 0.5 * len(list_intersect(qt, tt)) / 3 + 0.1 * len(list_filter(qt, lambda x: contains(l, x))), 6)::double as score from t where len(list_intersect(qt, tt)) > 0 or len(list_filter(qt, lambda x: contains(l, x))) > 0""")
def q_match_score(spark, d):
    return keyword.simple_match(B.nodes(spark, d), "the theron of").select("node_id", F.round("score", 6).alias("score"))


# Vectors


@query(f"with {_COS} select vec_id as node_id, score from cs order by score desc, vec_id limit 10")
def q_cosine_topk(spark, d):
    return R.top_k(B.scored_vectors(spark, d), 10).select("node_id", "score")


@query(f"select a.vec_id as node_id, round({_DOT}, 6) as score from embeddings a, embeddings b where b.vec_id = 0 order by score desc, node_id limit 10")
def q_ip_topk(spark, d):
    return R.top_k(B.scored_vectors(spark, d, "ip"), 10).select("node_id", "score")


@query("select a.vec_id as node_id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))), 6) as score from embeddings a, embeddings b where b.vec_id = 0 order by score desc, node_id limit 10")
def q_l2_topk(spark, d):
    return R.top_k(B.scored_vectors(spark, d, "l2"), 10).select("node_id", "score")


@query(f"with {_COS} select vec_id as node_id, score from (select * from cs order by score desc, vec_id limit 50) where score >= 0.2 order by score desc, vec_id limit 10")
def q_sim_threshold(spark, d):
    return R.top_k(R.threshold(R.top_k(B.scored_vectors(spark, d), 50), 0.2), 10).select("node_id", "score")


@query(f"select a.vec_id as a, b.vec_id as b, round({_DOT} / ({_NORMS}), 5) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {_DOT} / ({_NORMS}) >= 0.35")
def q_similar_pairs(spark, d):
    return semantic.similar_pairs(B.vectors(spark, d), 0.35, blocks=["label"]).withColumn("similarity", F.round("similarity", 5))


@query()
def q_ivf_topk(spark, d):
    from .operators.semantic import IvfIndex

    v = B.vectors(spark, d)
    q = [float(x) for x in B.query_vector(spark, d).first().q]
    return IvfIndex(v).search(q, 10).select("node_id", F.round("score", 6).alias("score"))


# Fusion

_RANKS = f"with {_BM25}, {_COS}, k as (select doc_id as node_id, score, row_number() over (order by score desc, doc_id) - 1 as r from bm qualify r < 20), s as (select vec_id as node_id, score, row_number() over (order by score desc, vec_id) - 1 as r from cs qualify r < 20), u as (select *, 0 as src, 0.3 as w from k union all select *, 1, 0.7 from s)"


def _both(spark, d):
    k = R.with_rank(R.top_k(_bm25(spark, d), 20)).select("node_id", "score", "rank")
    s = R.with_rank(R.top_k(B.scored_vectors(spark, d), 20)).select("node_id", "score", "rank")
    return k, s


def _fused(spark, d, mode):
    return R.top_k(R.fuse(*_both(spark, d), mode).withColumn("score", F.round("score", 6)), 10, order="node_id").select("node_id", "score")


@query(f"{_RANKS} select node_id, round(sum(1.0::double / (61 + r)), 6) as score from u group by node_id order by score desc, node_id limit 10")
def q_rrf(spark, d):
    return _fused(spark, d, "rrf")


@query(f"{_RANKS} select node_id, round(sum(w::double * score) / sum(w::double), 6) as score from u group by node_id order by score desc, node_id limit 10")
def q_weighted_sum(spark, d):
    return _fused(spark, d, "weighted_sum")


@query(f"{_RANKS} select node_id, max(score) as score from u group by node_id order by score desc, node_id limit 10")
def q_max_score(spark, d):
    return _fused(spark, d, "max_score")


@query(f"{_RANKS}, f as (select node_id, min(r * 2 + src) as turn from u group by node_id) select node_id, round(1 - (row_number() over (order by turn) - 1) / (count(*) over ())::double, 6) as score from f order by score desc, node_id limit 10")
def q_interleave(spark, d):
    return _fused(spark, d, "interleave")


# Voting and hierarchical retrieval

_LG = f"{_COS}, g as (select d.doc_id as node_id, c.score, c.label::varchar as entity, c.label::varchar || '/' || d.lang as timeline from documents d join cs c on d.doc_id = c.vec_id), el as (select entity as node_id, max(score) as score from g group by entity), tll as (select timeline as node_id, max(score) as score from g group by timeline)"
_VOTES = f"with {_LG}, e as (select *, row_number() over (order by score desc, node_id) - 1 as r from el qualify r < 3), t as (select *, row_number() over (order by score desc, node_id) - 1 as r from tll qualify r < 5), v as (select *, row_number() over (order by score desc, node_id) - 1 as r from g qualify r < 20), votes as (select g.node_id as event_id, 'entity' as layer, 0.25::double as w, e.score * 0.7 as v, e.r from e join g on g.entity = e.node_id union all select g.node_id, 'timeline', 0.30, t.score * 0.9, t.r from t join g on g.timeline = t.node_id union all select node_id, 'event', 0.45, score, r from v)"


def _layers(spark, d):
    g = B.label_graph(spark, d)
    el = g.groupBy(F.col("entity").alias("node_id")).agg(F.max("score").alias("score"))
    tl = g.groupBy(F.col("timeline").alias("node_id")).agg(F.max("score").alias("score"))
    return g, el, tl


def _votes(spark, d):
    g, el, tl = _layers(spark, d)
    rank = lambda df, k: R.with_rank(R.top_k(df.select("node_id", "score"), k, order="node_id"), order="node_id")
    return voting.collect_votes(rank(el, 3), rank(tl, 5), rank(g, 20), g.select(F.col("entity").alias("name"), F.col("node_id").alias("event_id")), g.select(F.col("timeline").alias("timeline_id"), F.col("node_id").alias("event_id")))


def _elected(spark, d, mode):
    out = voting.aggregate(_votes(spark, d), mode).withColumn("score", F.round("score", 6))
    return R.top_k(out, 50, order="event_id").select("event_id", "vote_count", "score")


@query(f"{_VOTES} select event_id, count(*) as vote_count, round(sum(w / (61 + r)), 6) as score from votes group by event_id order by score desc, event_id limit 50")
def q_vote_rrf(spark, d):
    return _elected(spark, d, "rrf")


@query(f"{_VOTES} select event_id, count(*) as vote_count, round(sum(w * v), 6) as score from votes group by event_id order by score desc, event_id limit 50")
def q_vote_weighted(spark, d):
    return _elected(spark, d, "weighted")


@query(f"{_VOTES} select event_id, count(*) as vote_count, round(least(count(*) / 10.0, 1)::double * 0.3 + avg(v) * 0.7, 6) as score from votes group by event_id order by score desc, event_id limit 50")
def q_vote_count(spark, d):
    return _elected(spark, d, "vote_count")


@query(f"{_VOTES} select event_id, count(*) as vote_count, round(sum(w * (m + 1 - r)), 6) as score from (select *, max(r) over (partition by layer) as m from votes) group by event_id order by score desc, event_id limit 50")
def q_vote_borda(spark, d):
    return _elected(spark, d, "borda")


_HIER = f"with {_LG}, e as (select *, row_number() over (order by score desc, node_id) - 1 as r from el qualify r < 3)"


def _hier(spark, d, key, ranked, k):
    g, el, tl = _layers(spark, d)
    ents = R.with_rank(R.top_k(el, 3, order="node_id"), order="node_id").withColumnRenamed("node_id", "name")
    edges = g.select(F.col("entity").alias("name"), F.col("node_id").alias("event_id"), F.col("timeline").alias("timeline_id"), F.col("ord")).select("name", key, "ord")
    cands = voting.related(ents, edges, key).withColumn("seen", F.col(key))
    every = R.with_rank((g if ranked == "g" else tl).select("node_id", "score"), order="node_id")
    return voting.rescore(cands, every, key, k, least=0.05).select(key, "score")


@query(f"{_HIER}, c as (select g.node_id from g join e on g.entity = e.node_id), a as (select node_id, score, row_number() over (order by score desc, node_id) - 1 as r from g) select c.node_id as event_id, coalesce(a.score, 0) as score from c left join a on a.node_id = c.node_id and a.r < (select count(*) from c) and a.score >= 0.05 order by score desc, event_id limit 20")
def q_hier_events(spark, d):
    return _hier(spark, d, "event_id", "g", 20)


@query(f"{_HIER}, c as (select distinct g.timeline as node_id from g join e on g.entity = e.node_id), a as (select node_id, score, row_number() over (order by score desc, node_id) - 1 as r from tll) select c.node_id as timeline_id, coalesce(a.score, 0) as score from c left join a on a.node_id = c.node_id and a.r < (select count(*) from c) and a.score >= 0.05 order by score desc, timeline_id limit 10")
def q_hier_timelines(spark, d):
    return _hier(spark, d, "timeline_id", "t", 10)


@query("select doc_id as event_id, round((case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'theron') then 1 else 0 end + case when contains(lower(text), 'zzz') then 1 else 0 end) / 3.0::double, 6) as score from documents join embeddings on doc_id = vec_id where label = 3")
def q_entity_context(spark, d):
    g = B.label_graph(spark, d).where("entity = '3'").select("node_id")
    events = B.nodes(spark, d).join(g, "node_id")
    return graph.entity_context(events, F.col("text"), "the theron zzz").select(F.col("node_id").alias("event_id"), F.round("score", 6).alias("score"))


# Graph


@query(f"with {_TEV}, n as (select 'node' as kind, 'entity' as type, count(distinct user_id) as n from tev union all select 'node', 'event', count(*) from tev union all select 'node', 'timeline', count(*) from tl union all select 'edge', 'participates_in', count(*) from tev union all select 'edge', 'belongs_to', count(*) from pos union all select 'edge', 'has_timeline', count(*) from tl) select kind, type, sum(n)::bigint as n from n group by grouping sets ((kind, type), (kind))")
def q_graph_stats(spark, d):
    return B.graph(spark, d).stats()


@query(f"""with {_TEV}, b as (select 'belongs_to' as edge, event_id::varchar as a, timeline_id as b, position::bigint as position from pos)
select * from b union all select 'participates_in', 'user' || user_id, event_id::varchar, null from tev union all select 'has_timeline', 'user' || user_id, timeline_id, null from tl""")
def q_edge_build(spark, d):
    g = graph.build(*B.stages(spark, d))
    none = F.lit(None).cast("long")
    edges = g.belongs.select(F.lit("belongs_to").alias("edge"), F.col("event_id").alias("a"), F.col("timeline_id").alias("b"), F.col("position").cast("long").alias("position"))
    edges = edges.unionByName(g.participates.select(F.lit("participates_in").alias("edge"), F.col("name").alias("a"), F.col("event_id").alias("b"), none.alias("position")))
    return edges.unionByName(g.has.select(F.lit("has_timeline").alias("edge"), F.col("name").alias("a"), F.col("timeline_id").alias("b"), none.alias("position")))


@query(f"with {_TEV} select 'user' || user_id as name, event_id, 'participant' as role, time_start from tev")
def q_entity_events(spark, d):
    g = B.graph(spark, d)
    return g.entity_events(g.entities).select("name", "event_id", "role", "time_start")


@query(f"with {_TEV} select 'user' || user_id as name, timeline_id from tl")
def q_entity_timelines(spark, d):
    g = B.graph(spark, d)
    return g.entity_timelines(g.entities).select("name", "timeline_id")


@query(f"with {_TEV} select event_id, 'user' || user_id as name from tev")
def q_event_entities(spark, d):
    g = B.graph(spark, d)
    return g.event_entities(g.events).select("event_id", "name")


@query(f"with {_TEV} select event_id, timeline_id, position from pos")
def q_event_timeline(spark, d):
    g = B.graph(spark, d)
    return g.event_timeline(g.events).select("event_id", "timeline_id", "position")


@query(f"with {_TEV} select timeline_id, position, event_id from tl join pos using (timeline_id)")
def q_timeline_events(spark, d):
    g = B.graph(spark, d)
    return g.timeline_events(g.entity_timelines(g.entities)).select("timeline_id", "position", "event_id")


@query(f"with {_TEV} select timeline_id, 'user' || user_id as name from tl")
def q_timeline_entity(spark, d):
    g = B.graph(spark, d)
    return g.timeline_entity(g.timelines).select("timeline_id", "name")


@query(f"with {_TEV} select 'user' || user_id as name from tev where 'u' || user_id in ('u7') or 'user' || user_id = 'u7' group by user_id")
def q_entities_by_name_exact(spark, d):
    return B.graph(spark, d).entities_by_name("u7").select("name")


@query("select c_name as name from customer where contains(lower(c_name), '#0000001')")
def q_entities_by_name_fuzzy(spark, d):
    c = B.table(spark, d, "customer")
    return c.where(graph.name_matches(F.col("c_name"), F.array().cast("array<string>"), "#0000001", True)).select(F.col("c_name").alias("name"))


@query(f"with {_TEV} select event_id, time_start from tev where substr(time_start, 1, 4)::int between 2025 and 2026")
def q_year_range(spark, d):
    return B.graph(spark, d).events_in_years("2025-03", "2026").select("event_id", "time_start")


# Times

_LOHI = "make_date(y, coalesce(m, 1), coalesce(d, 1)) as lo, case when d is not null then make_date(y, m, d) when m is not null then last_day(make_date(y, m, 1)) else make_date(y, 12, 31) end as hi"
_BOUNDS = f"b as (select event_id, user_id, a.lo, coalesce(z.hi, a.hi) as hi from (select event_id, user_id, {_LOHI} from (select event_id, user_id, {_PARTS.format('time_start')} from tev)) a join (select event_id as e2, hi from (select event_id, {_LOHI} from (select event_id, {_PARTS.format('time_end')} from tev))) z on z.e2 = a.event_id)"


def _bounds(spark, d):
    e = B.tev(spark, d).withColumn("s", T.parse("time_start")).withColumn("e", T.parse("time_end"))
    return e.select("event_id", "user_id", T.first_day("s").alias("lo"), F.coalesce(T.last_day("e"), T.last_day("s")).alias("hi"))


@query(f"with {_TEV}, {_BOUNDS} select event_id from b where lo <= date '2025-06-30' and hi >= date '2025-06-01'")
def q_interval_overlap(spark, d):
    return _bounds(spark, d).where("lo <= date '2025-06-30' and hi >= date '2025-06-01'").select("event_id")


@query(f"with {_TEV}, {_BOUNDS} select event_id from b where year(lo) <= 2026 and year(hi) >= 2026")
def q_contains_year(spark, d):
    return _bounds(spark, d).where((F.year("lo") <= 2026) & (F.year("hi") >= 2026)).select("event_id")


@query(f"with {_TEV}, {_BOUNDS} select a.event_id as a_id, b2.event_id as b_id from b a join b b2 on a.user_id = b2.user_id and a.event_id < b2.event_id and a.lo <= b2.hi and b2.lo <= a.hi")
def q_implicit_period_join(spark, d):
    b = _bounds(spark, d)
    out = provenance.overlaps(b.withColumnRenamed("event_id", "a_id"), b.withColumnRenamed("event_id", "b_id"), ["user_id"])
    return out.where("a_id < b_id").select("a_id", "b_id")


_BAD = "bad(k, s) as (values (1, null), (2, ''), (3, 'NULL'), (4, '2008'), (5, '2008-07'), (6, '2008-13'), (7, '2008-02-31'), (8, '2008/7/4'), (9, '20080704'), (10, 'circa 1999-7-4'), (11, '0999'), (12, '2150'), (13, 'summer 1984'), (14, '2008-7'), (15, '2008-7-45'), (16, 'x2008-12y'), (17, '2008-123'), (18, 'in 1987 and 1990'))"


def _bad_times(spark, d):
    bad = [(1, None), (2, ""), (3, "NULL"), (4, "2008"), (5, "2008-07"), (6, "2008-13"), (7, "2008-02-31"), (8, "2008/7/4"), (9, "20080704"), (10, "circa 1999-7-4"), (11, "0999"), (12, "2150"), (13, "summer 1984"), (14, "2008-7"), (15, "2008-7-45"), (16, "x2008-12y"), (17, "2008-123"), (18, "in 1987 and 1990")]
    return spark.createDataFrame(bad, "k int, s string").unionByName(B.tev(spark, d).select((F.col("event_id") + 100).cast("int").alias("k"), F.col("time_start").alias("s")))


_ALL_BAD = f"with {_TEV}, {_BAD}, r as (select k, s from bad union all select event_id::int + 100, time_start from tev)"
_OK = r"(s is null or s = '' or lower(s) = 'null' or regexp_full_match(s, '\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?'))"


@query(f"{_ALL_BAD} select k, {_OK} as valid from r")
def q_time_validate(spark, d):
    return _bad_times(spark, d).select("k", validate.is_valid(F.col("s")).alias("valid"))


@query(_ALL_BAD + r""", x as (select k, s, regexp_extract(s, '(\d{4})-(\d{1,2})-(\d{1,2})', ['y', 'm', 'd']) as a, regexp_extract(s, '(\d{4})-(\d{1,2})(?:\D|$)', ['y', 'm']) as b, regexp_extract(s, '\b(\d{4})\b', 1) as c from r)
select k, case when try_cast(a.m as int) between 1 and 12 and try_cast(a.d as int) between 1 and 31 then a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') when try_cast(b.m as int) between 1 and 12 then b.y || '-' || lpad(b.m, 2, '0') when try_cast(c as int) between 1000 and 2100 then c end as found from x""")
def q_time_extract(spark, d):
    return _bad_times(spark, d).select("k", validate.extract(F.col("s")).alias("found"))


@query(f"with {_TEV} select event_id, y, m, d, case when d is not null then 'day' when m is not null then 'month' else 'year' end as grain, time_start as text from (select event_id, time_start, {_PARTS.format('time_start')} from tev)")
def q_temporal_parse(spark, d):
    t = F.col("t")
    return B.tev(spark, d).withColumn("t", T.parse("time_start")).select("event_id", t["year"].alias("y"), t["month"].alias("m"), t["day"].alias("d"), T.granularity(t).alias("grain"), T.to_text(t).alias("text"))


def _shift(name, day, month, year):
    return f"with {_TEV}, p as (select event_id, {_PARTS.format('time_start')} from tev) select event_id, case when d is not null then {day} when m is not null then {month} else {year} end as {name} from p"


@query(_shift("moved", "strftime(make_date(y, m, d) + interval 31 month, '%Y-%m-%d')", "strftime(make_date(y, m, 1) + interval 31 month, '%Y-%m')", "null"))
def q_add_months(spark, d):
    return B.tev(spark, d).withColumn("t", T.parse("time_start")).withColumn("t", T.add_months("t", 31)).select("event_id", T.to_text("t").alias("moved"))


@query(_shift("moved", "strftime(make_date(y, m, d) - interval 3 year, '%Y-%m-%d')", "strftime(make_date(y, m, 1) - interval 3 year, '%Y-%m')", "(y - 3)::varchar"))
def q_add_years(spark, d):
    return B.tev(spark, d).withColumn("t", T.parse("time_start")).withColumn("t", T.add_years("t", -3)).select("event_id", T.to_text("t").alias("moved"))


@query(_shift("moved", "strftime(make_date(y, m, d) + interval 20 day, '%Y-%m-%d')", "null", "null"))
def q_add_days(spark, d):
    return B.tev(spark, d).withColumn("t", T.parse("time_start")).withColumn("t", T.add_days("t", 20)).select("event_id", T.to_text("t").alias("moved"))


@query(f"with {_TEV}, p as (select event_id, {_PARTS.format('time_start')} from tev), z as (select event_id, {_PARTS.format('time_end')} from tev) select p.event_id, coalesce(z.y - p.y, 0) as years, coalesce(z.m - p.m, 0) as months, coalesce(z.d - p.d, 0) as days from p join z using (event_id) where z.y is not null")
def q_date_diff_parts(spark, d):
    e = B.tev(spark, d).where("time_end is not null")
    return e.select("event_id", T.subtract(T.parse("time_end"), T.parse("time_start")).alias("x")).select("event_id", "x.years", "x.months", "x.days")


@query("select o_orderkey, (o_orderdate::date - date '0001-01-01')::bigint + 1 as n from orders")
def q_ordinal(spark, d):
    t = T.parse(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return B.table(spark, d, "orders").select("o_orderkey", T.ordinal(t).cast("long").alias("n"))


# Duplicates and timelines

_DESC = "user_id || ' ' || event_type"


@query(f"with {_TEV} select min(event_id) as event_id from tev group by user_id, event_type, time_start")
def q_dedupe_exact(spark, d):
    e = B.tev(spark, d).select("event_id", "ord", F.col("user_id").alias("chunk_id"), F.col("event_type").alias("original_sentence"), F.col("time_start").alias("time_expression"), F.lit("").alias("event_description"))
    return dedupe.exact(e).select("event_id")


@query(f"""with recursive {_TEV}, ev as (select event_id, user_id as doc, lower(trim({_DESC})) as k, time_type as tt, time_start as s, time_end as e, length(time_start) - 1 as gs, case length(time_start) when 4 then 1 when 7 then 2 else 3 end + case length(time_end) when 4 then 1 when 7 then 2 when 10 then 3 else 0 end as sc, row_number() over (partition by user_id, event_type order by event_id) as rn from tev),
f as (select doc, k, 1 as rn, [event_id] as heads, [struct_pack(h := event_id, id := event_id, sc := sc)] as got, [struct_pack(id := event_id, tt := tt, s := s, e := e)] as hd from ev where rn = 1
 union all select doc, k, f.rn + 1, case when fit is null then list_append(heads, event_id) else heads end, list_append(got, struct_pack(h := coalesce(fit, event_id), id := event_id, sc := sc)), case when fit is null then list_append(hd, struct_pack(id := event_id, tt := tt, s := s, e := e)) else hd end
 from (select f.*, ev.event_id, ev.tt, ev.s, ev.e, ev.sc, list_filter(f.hd, lambda h: h.tt = ev.tt and (starts_with(h.s, ev.s) or starts_with(ev.s, h.s)) and ((h.e is null and ev.e is null) or coalesce(starts_with(h.e, ev.e) or starts_with(ev.e, h.e), false)))[1].id as fit from f join ev on ev.doc = f.doc and ev.k = f.k and ev.rn = f.rn + 1) f),
l as (select doc, k, got from f qualify row_number() over (partition by doc, k order by rn desc) = 1), u as (select unnest(got) as g from l)
select arg_max(g.id, (g.sc, -g.id)) as event_id, count(*)::int as n_merged from u group by g.h""")
def q_dedupe_overlap(spark, d):
    e = B.tev(spark, d)
    events = e.select(F.col("event_id").cast("string").alias("event_id"), "ord", F.col("user_id").alias("doc_id"), F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("event_description"), "time_type", "time_start", "time_end", F.lit("c").alias("chunk_id"))
    return dedupe.overlapping(events).select(F.col("event_id").cast("long").alias("event_id"), "n_merged")


@query(f"with {_TEV} select timeline_id, min(time_start) as time_span_start, max(coalesce(time_end, time_start)) as time_span_end from pos join tev using (event_id) group by timeline_id")
def q_timeline_span(spark, d):
    g = B.graph(spark, d)
    s, e = timeline.span(F.col("time_start"), F.col("time_end"))
    return g.belongs.join(g.events, "event_id").groupBy("timeline_id").agg(s, e)


@query(f"with {_TEV} select event_id, ((row_number() over (partition by user_id order by time_start, event_id) - 1) // 20)::int as batch from tev")
def q_timeline_batches(spark, d):
    return timeline.batches(B.tev(spark, d).withColumnRenamed("user_id", "entity")).select("event_id", "batch")


_TURNS = "t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, length(text) as n from conversations)"


def _turns(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = B.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), "turn", (F.row_number().over(by) - 1).alias("chunk_index"), F.array(F.length("text")).alias("events"))


def _prior(spark, d, mode):
    out = timeline.prior_events(_turns(spark, d), mode, 3)
    return out.select(F.col("doc_id").alias("conv_id"), "turn", F.size("prior").alias("n"), F.aggregate("prior", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))


@query(f"with {_TURNS} select conv_id, turn, count(n) over w::int as n, coalesce(sum(n) over w, 0)::bigint as chars from t window w as (partition by conv_id order by i rows between unbounded preceding and 1 preceding)")
def q_prior_full(spark, d):
    return _prior(spark, d, "full")


@query(f"with {_TURNS} select a.conv_id, a.turn, count(b.n)::int as n, coalesce(sum(b.n), 0)::bigint as chars from t a left join t b on a.conv_id = b.conv_id and b.i < a.i and (b.i = 0 or b.i >= a.i - 3) group by all")
def q_prior_sliding(spark, d):
    return _prior(spark, d, "sliding")


@query(f"with {_TURNS} select i::int as round, count(*) as n from t group by i")
def q_chunk_batches(spark, d):
    return timeline.rounds(_turns(spark, d)).groupBy(F.col("round").cast("int")).agg(F.count(F.lit(1)).alias("n"))


# Provenance


def _conv_chunks(spark, d):
    c = B.table(spark, d, "conversations")
    return c.select(X.numbered(F.col("conv_id"), "chunk", F.col("turn").cast("int")).alias("chunk_id"), "role").dropDuplicates(["chunk_id"])


_CHUNKS = "c as (select distinct conv_id, turn, conv_id::varchar || '-chunk-' || lpad(turn::varchar, 4, '0') as chunk_id from conversations), i as (select *, turn - row_number() over (partition by conv_id order by turn) as g from c)"


@query(f"with {_CHUNKS} select a.chunk_id as centre, b.chunk_id, (b.turn - a.turn)::int as offset from i a join i b on a.conv_id = b.conv_id and a.g = b.g and b.turn between a.turn - 2 and a.turn + 1")
def q_surrounding_chunks(spark, d):
    c = _conv_chunks(spark, d)
    return provenance.surrounding(c, c, 2, 1).select("centre", "chunk_id", "offset")


@query(f"with {_CHUNKS} select event_id, c.chunk_id from events join c on c.chunk_id = (event_id % 97)::varchar || '-chunk-' || lpad((event_id % 7)::varchar, 4, '0')")
def q_events_to_chunks(spark, d):
    e = B.tev(spark, d).select("event_id", "ord", X.numbered((F.col("event_id") % 97).cast("string"), "chunk", (F.col("event_id") % 7).cast("int")).alias("chunk_id"))
    return provenance.event_chunks(e, _conv_chunks(spark, d)).select("event_id", "chunk_id")


@query(f"with {_TEV}, {_COS}, h as (select vec_id as event_id, score, row_number() over (order by score desc, vec_id) - 1 as r from cs qualify r < 10), t as (select timeline_id, row_number() over (order by timeline_id) - 1 as r from (select timeline_id from tl order by timeline_id limit 3)), u as (select event_id, score, 0 as s, r, 0 as p from h union all select event_id, 0, 1, t.r, position from t join pos using (timeline_id)) select event_id, score from u qualify row_number() over (partition by event_id order by s, r, p) = 1")
def q_merge_timeline_events(spark, d):
    g = B.graph(spark, d)
    hits = R.with_rank(R.top_k(B.scored_vectors(spark, d), 10)).select(F.col("node_id").alias("event_id"), "score", "rank")
    lines = g.timelines.orderBy("timeline_id").limit(3).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("timeline_id")) - 1)
    return provenance.expand_timelines(hits, lines, g.belongs).select("event_id", "score")


# JSON and aggregates


@query("select event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) as first from events")
def q_json_props(spark, d):
    key = F.element_at(F.json_object_keys("props"), 1)
    return B.table(spark, d, "events").select("event_id", F.element_at(F.from_json("props", "map<string,string>"), key).alias("first"))


_YEARS = "substr(time_start, 1, 4)::int"
_FNS = {"count": "count(*)", "sum": f"sum({_YEARS})", "average": f"avg({_YEARS})", "min": f"min({_YEARS})", "max": f"max({_YEARS})"}


@query(f"with {_TEV}, e as (select * from tev where event_type = 'click') " + " union all ".join(f"select '{k}' as fn, round(({v})::double, 6) as value from e" for k, v in _FNS.items()))
def q_subtask_aggs(spark, d):
    run = questions.OPERATIONS
    clicks = run["filter"]([B.tev(spark, d)], {"condition": "event_type = 'click'"})
    years = run["transform"]([clicks], {"name": "year", "expression": "cast(substring(time_start, 1, 4) as int)"})
    out = None
    for fn in _FNS:
        row = run["aggregate"]([years], {"fn": fn, "column": "year"}).select(F.lit(fn).alias("fn"), F.round(F.col("value").cast("double"), 6).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


_VERBS = "|".join(rf"\b{v}\b" for v in ("play(ed)?[\\x09-\\x0D\\x20]+for", "work(ed)?[\\x09-\\x0D\\x20]+at", "served?[\\x09-\\x0D\\x20]+as", "joined?", "married[\\x09-\\x0D\\x20]+to", "held?", "became", "won", "scored?"))


@query(rf"""with t as (select 'c' || c_custkey as k, c_name as s from customer union all select 'p' || p_partkey, p_name from part union all select 'd' || doc_id, text from documents),
    w as (select k, s, list_filter(string_split_regex(lower(trim(s, ' ')), '[\x09-\x0D\x20]+'), lambda x: x <> '') as w from t)
select k, not contains(s, '?') and not list_has_any(w, {X.QUESTION_WORDS!r}) and not regexp_matches(lower(trim(s, ' ')), '{_VERBS}') and len(w) <= 10 as single from w""")
def q_single_entity(spark, d):
    named = lambda table, mark, key, text: B.table(spark, d, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("k"), F.col(text).alias("s"))
    t = named("customer", "c", "c_custkey", "c_name").unionByName(named("part", "p", "p_partkey", "p_name")).unionByName(named("documents", "d", "doc_id", "text"))
    return t.select("k", X.is_single_entity("s").alias("single"))


@query()
def q_cluster_entities(spark, d):
    v = B.vectors(spark, d)
    mentions = v.select(F.col("node_id").alias("mention_id"), "ord", F.concat(F.lit("n"), "node_id").alias("name"), F.concat(F.lit("n"), "node_id").alias("canonical_name"), F.lit("").alias("description"), F.col("node_id").cast("string").alias("event_id"), "embedding", "label")
    return cluster.summarise(cluster.clusters(mentions, least=0.35, block=["label"])).select("cluster_id", "canonical_name", "member_count")


# Validation, answers and tables of the extraction's stages

_OK_BEFORE = r"(was is null or was = '' or lower(was) = 'null' or regexp_full_match(was, '\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?'))"
_REPAIRED = _ALL_BAD + r""", x as (select k, s, regexp_extract(s, '(\d{4})-(\d{1,2})-(\d{1,2})', ['y', 'm', 'd']) as a,
    regexp_extract(s, '(\d{4})-(\d{1,2})(?:\D|$)', ['y', 'm']) as b, regexp_extract(s, '\b(\d{4})\b', 1) as c from r),
found as (select k, s, case
    when try_cast(a.m as int) between 1 and 12 and try_cast(a.d as int) between 1 and 31 then a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0')
    when try_cast(b.m as int) between 1 and 12 then b.y || '-' || lpad(b.m, 2, '0')
    when try_cast(c as int) between 1000 and 2100 then c end as found from x),
fixed as (select k, s as was, case when """ + _OK + """ then s else coalesce(found, s) end as s from found),
v as (select k, s, case when """ + _OK_BEFORE + " then 'valid' when " + _OK + " then 'rule_fixed' else 'invalid' end as status from fixed)"


def _validated(spark, d, answers=None):
    rows = _bad_times(spark, d).select(F.col("k").alias("event_id"), F.col("s").alias("time_start"), F.when(F.col("k") % 2 == 1, F.col("s")).alias("time_end"))
    return validate.validate(rows, answers)


@query(f"{_REPAIRED} select k as event_id, s as time_start, case when k % 2 = 1 then s end as time_end, status, case when status = 'valid' then 0 else 1 + k % 2 end::int as n_issues from v")
def q_issues(spark, d):
    return _validated(spark, d).select("event_id", "time_start", "time_end", "status", F.size("issues").alias("n_issues"))


_FIX = {0: "2001", 1: "null", 2: "not a time"}


@query(f"""{_REPAIRED}, w as (select k, status, case when status <> 'invalid' or k % 3 = 2 then s when k % 3 = 0 then '2001' end as s,
    case when k % 2 = 1 then s end as e from v)
select k as event_id, s as time_start, case when status = 'invalid' and k % 2 = 1 then null else e end as time_end,
    case when status = 'invalid' and k % 3 <> 2 then 'llm_fixed' else status end as status from w""")
def q_answer_merge(spark, d):
    fix = F.when(F.col("k") % 3 == 0, _FIX[0]).when(F.col("k") % 3 == 1, _FIX[1]).otherwise(_FIX[2])
    fixes = _bad_times(spark, d).select(F.col("k").alias("event_id"), F.struct(fix.alias("time_start"), F.lit("null").alias("time_end")).alias("fix"))
    return _validated(spark, d, fixes).select("event_id", "time_start", "time_end", "status")


@query(f"{_REPAIRED} select status, count(*) as n from v group by status")
def q_validation_summary(spark, d):
    return validate.summary(_validated(spark, d))


@query("""select event_id, case when event_id % 5 = 0 then null else event_id end as n, case when event_id % 5 = 0 then null else event_type end as kind from events""")
def q_json_answer(spark, d):
    e = B.table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").alias("n"), F.col("event_type").alias("kind")))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))
    told = F.when(F.col("event_id") % 5 == 0, F.lit('{"n": ')).when(F.col("event_id") % 2 == 0, body).otherwise(fenced)
    return e.select("event_id", X.answer(told, "n long, kind string").alias("a")).select("event_id", "a.n", "a.kind")


_MENTIONS = f"with {_TEV}, m as (select event_id, event_type as name, 'cluster-' || user_id as cluster_id from tev)"


def _labelled(spark, d):
    kind = F.col("event_type")
    return B.tev(spark, d).select(kind.alias("name"), kind.alias("canonical_name"), kind.alias("description"), F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("cluster-"), F.col("user_id").cast("string")).alias("cluster_id"), "ord")


@query(f"""{_MENTIONS} select cluster_id, arg_max(name, (length(name), -event_id)) as canonical_name, array_to_string(list_sort(list(distinct name)), '; ') as merged_description,
    count(*)::int as member_count, array_to_string(list_sort(list(distinct event_id::varchar)), ',') as ids, min(event_id) as ord, string_agg(name, ',' order by event_id) as members from m group by cluster_id""")
def q_cluster_summary(spark, d):
    out = cluster.summarise(_labelled(spark, d))
    ids, members = F.array_join("source_event_ids", ","), F.array_join(F.transform("member_entities", lambda m: m["name"]), ",")
    return out.select("cluster_id", "canonical_name", "merged_description", "member_count", ids.alias("ids"), "ord", members.alias("members"))


@query(f"{_MENTIONS} select name as text, arg_max(cluster_id, event_id) as cluster_id from m group by name")
def q_mention_map(spark, d):
    return cluster.mention_map(_labelled(spark, d))


@query(f"with {_TEV} select 'user' || user_id as entity, event_id from tev where user_id in (select c_custkey from customer where c_nationkey < 12)")
def q_events_by_entity(spark, d):
    e = B.stages(spark, d)[0].select(F.col("event_id").cast("long").alias("event_id"), "entities")
    asked = B.table(spark, d, "customer").where("c_nationkey < 12").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("name"))
    return timeline.by_entity(e, asked).select("entity", "event_id")


_BATCHED = f"with {_TEV}, bt as (select *, ((row_number() over (partition by user_id order by time_start, event_id) - 1) // 20)::int as batch from tev)"


def _told(spark, d):
    """What each batch of an entity's events says of its timelines: one for every type."""
    e = timeline.batches(B.tev(spark, d).withColumn("entity", F.concat(F.lit("user"), F.col("user_id").cast("string"))))
    line = F.concat_ws("/", "entity", "event_type").alias("timeline_id")
    return e.groupBy("entity", "batch", line).agg(F.array_sort(F.collect_list("event_id")).alias("event_ids")).withColumn("timeline_name", F.concat_ws(" ", F.lit("part"), "batch")).withColumn("description", F.lit(""))


@query(f"""{_BATCHED} select 'user' || user_id as entity, 'user' || user_id || '/' || event_type as timeline_id, 'part ' || min(batch) as timeline_name, min(batch) as first_batch,
    string_agg(event_id::varchar, ',' order by batch, event_id) as ids, min(time_start) as time_span_start, max(coalesce(time_end, time_start)) as time_span_end from bt group by user_id, event_type""")
def q_merge_batches(spark, d):
    out = timeline.merge_batches(_told(spark, d), B.tev(spark, d))
    return out.select("entity", "timeline_id", "timeline_name", "first_batch", F.array_join("event_ids", ",").alias("ids"), "time_span_start", "time_span_end")


@query(f"{_BATCHED}, one as (select user_id, batch, event_type, min(event_id) as event_id from bt group by all having count(*) = 1) select 'user' || user_id as entity, event_id from one where event_id not in (select event_id from pos where not ends_with(timeline_id, '/click'))")
def q_standalone(spark, d):
    alone = _told(spark, d).where(F.size("event_ids") == 1).select("entity", F.col("event_ids")[0].alias("event_id"), F.lit("alone").alias("reason"))
    lines = B.stages(spark, d)[2].where(~F.col("timeline_id").endswith("/click")).select(F.col("entity_canonical_name").alias("entity"), F.transform("event_ids", lambda x: x.cast("long")).alias("event_ids"))
    return timeline.standalone(alone, lines).select("entity", "event_id")


@query(f"with {_TEV} select 'user' || user_id || '/' || event_type as line, printf('timeline-%04d', row_number() over (order by user_id, first) - 1) as timeline_id from tl")
def q_timeline_numbers(spark, d):
    lines = B.graph(spark, d).timelines.select(F.col("timeline_id").alias("line"), F.col("user_id").alias("entity_ord"), F.col("ord").alias("position"))
    return timeline.numbered_timelines(lines).select("line", "timeline_id")


@query(f"with {_TURNS} select conv_id, turn, 0 as n, 0::bigint as chars from t")
def q_prior_none(spark, d):
    return _prior(spark, d, "none")


# Graph and ranking, further


@query(f"with {_TEV} select 'entity' as kind, 'user7' as key, min(event_id) as ord from tev where user_id = 7 having count(*) > 0 union all select 'event', '12', event_id from tev where event_id = 12 union all select 'timeline', timeline_id, first from tl where timeline_id = 'user7/click'")
def q_point_lookup(spark, d):
    g = B.graph(spark, d)
    found = [("entity", g.entity("user7"), "name"), ("event", g.event("12"), "event_id"), ("timeline", g.timeline("user7/click"), "timeline_id")]
    rows = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "ord") for kind, df, key in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"with {_TEV} select 'user' || user_id as key, min(event_id) as ord from tev group by user_id union all select timeline_id, first from tl")
def q_list_keys(spark, d):
    g = B.graph(spark, d)
    return g.keys("entity").withColumnRenamed("name", "key").unionByName(g.keys("timeline").withColumnRenamed("timeline_id", "key"))


@query(f"with {_TEV} select 'belongs_to' as type, count(*) as n from pos union all select 'participates_in', count(*) from tev union all select 'has_timeline', count(*) from tl union all select 'entity', count(distinct user_id) from tev union all select 'event', count(*) from tev union all select 'timeline', count(*) from tl")
def q_build_report(spark, d):
    return graph.build_report(graph.build(*B.stages(spark, d)))


@query(f"with {_COS} select label, vec_id as node_id, score, row_number() over (partition by label order by score desc, vec_id) - 1 as rank from cs qualify rank < 3")
def q_grouped_topk(spark, d):
    return R.top_k_within(B.scored_vectors(spark, d), ["label"], 3).select("label", "node_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_TEV} select user_id, event_type, max(event_id) as event_id from tev group by all")
def q_last_wins(spark, d):
    return R.last_wins(B.tev(spark, d), ["user_id", "event_type"], "ord").select("user_id", "event_type", "event_id")


@query(f"{_VOTES}, s as (select event_id, count(*) as vote_count, sum(w * v) as score from votes group by event_id having count(*) >= 3) select event_id, vote_count, round(score, 6) as score, vote_count::int as n_details, (select string_agg(layer, ',' order by layer) from votes x where x.event_id = s.event_id) as layers from s where score >= 0.1")
def q_elect(spark, d):
    # three votes take one of the event layer, which has 20
    out = voting.elect(_votes(spark, d), B.tev(spark, d).select("event_id", "ord"), 20, "weighted", min_votes=3, min_score=0.1, details=True)
    return out.select("event_id", "vote_count", F.round("score", 6).alias("score"), F.size("votes").alias("n_details"), F.array_join(F.transform("votes", lambda v: v["layer"]), ",").alias("layers"))


@query(f"{_HIER} select g.node_id, e.node_id as names, e.score as top from g left join e on g.entity = e.node_id")
def q_provenance(spark, d):
    g, el, _ = _layers(spark, d)
    ents = R.with_rank(R.top_k(el, 3, order="node_id"), order="node_id").withColumnRenamed("node_id", "name")
    out = voting.provenance(g.select("node_id"), g.select(F.col("entity").alias("name"), "node_id", "ord"), ents, "node_id")
    return out.select("node_id", F.array_join("source_entity_names", ",").alias("names"), F.element_at("source_entity_scores", 1).alias("top"))


@query(f"with {_CHUNKS}, h as (select distinct c.chunk_id from events join c on c.chunk_id = (event_id % 97)::varchar || '-chunk-' || lpad((event_id % 7)::varchar, 4, '0')) select a.chunk_id as centre, b.chunk_id, (b.turn - a.turn)::int as offset from i a join i b on a.conv_id = b.conv_id and a.g = b.g and b.turn between a.turn - 1 and a.turn + 2 where a.chunk_id in (select chunk_id from h)")
def q_surrounding_events(spark, d):
    e = B.tev(spark, d).select("event_id", "ord", X.numbered((F.col("event_id") % 97).cast("string"), "chunk", (F.col("event_id") % 7).cast("int")).alias("chunk_id"))
    return provenance.surrounding_events(e, _conv_chunks(spark, d), 1, 2).select("centre", "chunk_id", "offset")


# Texts and times, further


@query(f"""with {_TEV} select event_id, concat_ws(' ', event_type, time_start, time_end, 'u' || user_id || ' ' || event_type) as event, concat_ws(' ', event_type, time_type, 'u' || user_id) as entity,
    concat_ws(' ', event_type, time_end, time_type) as timeline, concat_ws('|', event_type, time_start, time_end) as embedded, trim(event_type || ' ' || event_type || '. ' || coalesce(time_end, '')) as disambiguation,
    event_type || '(u' || user_id || ', ' || time_type || ', ' || time_start || case when time_end is null then '' else ', ' || time_end end || ')' as relation from tev""")
def q_texts(spark, d):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return B.tev(spark, d).select(
        "event_id",
        X.event_text("event_type", "time_start", "time_end", F.array(user, F.col("event_type"))).alias("event"),
        X.entity_text("event_type", "time_type", F.array(user)).alias("entity"),
        X.timeline_text("event_type", "time_end", "time_type").alias("timeline"),
        X.embed_text("event_type", "time_start", "time_end").alias("embedded"),
        X.disambiguation_text("event_type", "time_end", 2.0).alias("disambiguation"),
        X.relation_text("event_type", user, "time_type").alias("relation"),
    )


@query(f"with {_TEV}, p as (select event_id, user_id, {_PARTS.format('time_start')} from tev) select user_id, arg_min(event_id, (y, coalesce(m, 0), coalesce(d, 0), event_id)) as first, arg_max(event_id, (y, coalesce(m, 0), coalesce(d, 0), event_id)) as last from p group by user_id")
def q_time_order(spark, d):
    e = B.tev(spark, d).withColumn("o", F.struct(T.order_key(T.parse("time_start")).alias("t"), "event_id"))
    return e.groupBy("user_id").agg(F.min_by("event_id", "o").alias("first"), F.max_by("event_id", "o").alias("last"))


@query(f"with {_TEV} select event_id, case length(time_start) when 4 then '%d/%m' when 7 then '%d/' || time_start[6:7] else time_start[9:10] || '/' || time_start[6:7] end || '/' || time_start[1:4] || ' ' || time_start[3:4] as shown, case length(time_start) when 4 then 1 when 7 then 2 else 3 end as grain, time_start[1:4]::int as year from tev")
def q_time_format(spark, d):
    e = B.tev(spark, d).withColumn("t", T.parse("time_start"))
    return e.select("event_id", T.formatted("t", "%d/%m/%Y %y").alias("shown"), T.granularity_score("time_start").alias("grain"), T.year_prefix("time_start").alias("year"))


@query("select o_orderkey, strftime(o_orderdate::date, '%Y-%m-%d') as day from orders")
def q_from_ordinal(spark, d):
    n = F.datediff("o_orderdate", F.lit("0001-01-01").cast("date")) + 1
    return B.table(spark, d, "orders").select("o_orderkey", T.to_text(T.from_ordinal(n)).alias("day"))


_STOP = ["the", "of", "and", "to", "in", "is", "a"]


@query(f"select doc_id, len(t)::int as n, array_to_string(list_sort(list_distinct(t)), ' ') as words from (select doc_id, list_filter({_TOKENS.format('text')}, lambda x: not list_contains({_STOP!r}, x)) as t from documents)")
def q_tokens_stopped(spark, d):
    t = B.documents(spark, d).select("doc_id", X.tokens("text", stopwords=_STOP).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("words"))


@query("with v as (select vec_id, embedding::double[] as e from embeddings), n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v) select vec_id, round(u[1], 6) as first, round(u[-1], 6) as last, round(list_dot_product(u, u), 6) as squared from n")
def q_normalised(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", V.normalised("embedding").alias("u"))
    return v.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(V.dot("u", "u"), 6).alias("squared"))


# Relations and plans


def _named_events(spark, d):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return B.tev(spark, d).withColumn("event_description", F.col("event_type")).withColumn("entity_names", F.array(user, F.col("event_type"), F.col("time_type")))


@query(f"""with {_TEV}, o as (select *, 0 as i, event_type as other from tev union all select *, 1, time_type from tev)
select event_id || '-rel-' || i as relation_id, 'related_to' as relation_type, 'u' || user_id as subject, other as object_entity, time_start, time_end, 1.0::double as confidence, event_id::varchar as source, event_type as source_description from o""")
def q_structurise(spark, d):
    out = relations.structurise(_named_events(spark, d), providers.Rules(relations.by_rule()))
    return out.select("relation_id", "relation_type", "subject", "object_entity", "time_start", "time_end", "confidence", F.array_join("source_event_ids", ",").alias("source"), "source_description")


@query(f"with {_TEV}, {_BOUNDS} select event_id || '-rel-' || i as relation_id from b, (values (0), (1)) as v(i) where lo <= date '2026-02-28' and hi >= date '2025-03-01'")
def q_relations_in_time(spark, d):
    out = relations.structurise(_named_events(spark, d), providers.Rules(relations.by_rule()))
    return relations.in_time(out, "2025-03", "2026-02").select("relation_id")


@query(f"with {_TEV}, {_BOUNDS} select count(*) as value from b join tev using (event_id) where event_type = 'click' and lo <= date '2026-12-31' and hi >= date '2025-01-01'")
def q_plan_execute(spark, d):
    made = questions.plan("How many events of click happened between 2025 and 2026?")
    events = B.tev(spark, d).withColumn("event_description", F.col("event_type"))
    run = questions.execute(made, lambda text: questions.OPERATIONS["mentions"]([events], {"text": "click"}))
    if not run["success"]:
        raise ValueError(run["status"])
    return run["final"]


@query(f"with {_TEV}, {_BOUNDS}, p as (select min(lo) as l, max(hi) as h from b where user_id = 3) select event_id from b, p where lo <= h and hi >= l")
def q_plan_overlap(spark, d):
    e = B.tev(spark, d)
    return questions.OPERATIONS["overlap"]([e, e.where("user_id = 3")], {}).select("event_id")


@query(f"with {_TEV} select a, b, a > b as value from (select count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'view') as b from tev)")
def q_plan_compare(spark, d):
    run, e = questions.OPERATIONS, B.tev(spark, d)
    one = lambda kind: run["aggregate"]([e.where(F.col("event_type") == kind)], {"fn": "count"})
    return run["compare"]([one("click"), one("view")], {"sign": ">"})
