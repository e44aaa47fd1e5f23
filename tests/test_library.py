"""Goldens, plain versions and round trips of the library's own parts."""

import json

import numpy as np
from pyspark.sql import functions as F

from chronoweave.config import COMPACT, Config
from chronoweave.functions import temporal as T
from chronoweave.functions import text as X
from chronoweave.functions import vector as V
from chronoweave.operators import chunking, cluster, dedupe, provenance, semantic, timeline, validate
from chronoweave.operators.graph import Graph
from chronoweave.plans import extraction, questions
from chronoweave.plans.providers import Replay
from chronoweave.sources import files
from chronoweave.streaming import distinct_events, timeline_spans, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_partial_dates(spark):
    p = lambda s: T.parse(F.lit(s))
    for text, n, want in (("2002-09", -1, "2001-09"), ("2004-02-29", 1, "2005-02-28"), ("1999", 3, "2002")):
        assert one(spark, T.to_text(T.add_years(p(text), n))) == want
    for text, n, want in (("2002-09-15", -2, "2002-07-15"), ("2002-01", -2, "2001-11"), ("2003-01-31", 1, "2003-02-28"), ("2002", 1, None)):
        assert one(spark, T.to_text(T.add_months(p(text), n))) == want
    assert one(spark, T.to_text(T.add_days(p("2002-09-15"), 20))) == "2002-10-05"
    for text, want in (("2008/7-4", "2008-07-04"), ("20080704", "2008-07-04"), ("200807", "2008-07"), (" 2008 ", "2008"), ("2008-02-31", None), ("2008-13", None), ("0000", None), ("x", None)):
        assert one(spark, T.to_text(p(text))) == want, text
    for a, b, want in (("2008", "2008-07", True), ("2008", "2009", False), ("2008-02-31", "2008-02-31", True), (None, "2008", False), (None, None, True)):
        null = F.lit(None).cast("string")
        assert one(spark, T.compatible(F.lit(a) if a else null, F.lit(b) if b else null)) is want
    assert one(spark, T.order_key(p("2008")) < T.order_key(p("2008-01"))) and one(spark, T.order_key(p("2008-01")) < T.order_key(p("2008-01-01")))
    assert one(spark, T.ordinal(p("0001-01-01"))) == 1 and one(spark, T.to_text(T.from_ordinal(F.lit(733042)))) == "2008-01-01"
    assert one(spark, T.formatted(p("2008-07"), "%d/%m/%y")) == "%d/07/08"
    assert one(spark, T.subtract(p("2010-03"), p("2008-05-02"))).asDict() == {"years": 2, "months": -2, "days": 0}
    assert str(one(spark, T.last_day(p("2008-02")))) == "2008-02-29" and one(spark, T.year_prefix(F.lit("1987x"))) == 1987


def test_text(spark):
    assert one(spark, X.tokens(F.lit("Été a L'île x42 ok"))) == ["été", "île", "x42", "ok"]
    r = lambda *v: X.relation_text(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in v])
    assert one(spark, r("plays_for", "X", "Y", "2010", "2015")) == "plays_for(X, Y, 2010, 2015)"
    assert one(spark, r("plays_for", "X", "Y", None, "2015")) == "plays_for(X, Y)"
    assert one(spark, X.numbered(F.lit("d"), "chunk", F.lit(12345))) == "d-chunk-12345"
    assert one(spark, X.chunk_doc(F.lit("a-chunk-1-chunk-0007"))) == "a-chunk-1"
    assert one(spark, X.answer(F.lit('say ```json\n{"answer":"x"}\n```'), "struct<answer:string>")).answer == "x"


def test_sentence_chunks(spark):
    text = " ".join(f"Sentence number {k} is here." for k in range(25)) + " Hm."
    docs = spark.createDataFrame([("d", text), ("e", "  "), ("f", "Short one.")], "doc_id string, content string")
    rows = chunking.by_sentences(docs, most=10, overlap=2, least=20).where("doc_id = 'd'").orderBy("chunk_index").collect()
    assert len(rows) == 3 and rows[1].content.startswith("Sentence number 8 is here. Sentence number 9")
    assert text[rows[1].start_char :].startswith("Sentence number 8")
    cuts = chunking.by_chars_at_sentences(docs, size=100, overlap=20, least=30).where("doc_id = 'd'").collect()
    assert all(text[c.start_char : c.end_char].strip() == c.content for c in cuts) and max(c.end_char for c in cuts) == len(text)
    ids = chunking.by_model_tokens(docs, lambda t: [ord(c) for c in t], lambda x: "".join(map(chr, x)), size=200, overlap=50, least=10).where("doc_id = 'd'").collect()
    assert all(text[c.start_char : c.end_char].strip() == c.content for c in ids)


def test_validation(spark):
    e = spark.createDataFrame([("1", "2008-13-01", None), ("2", "2008", "x 2009-01-02 y"), ("3", "soon", None), ("4", "2001", "null")], "event_id string, time_start string, time_end string")
    fixes = spark.createDataFrame([("3", ("2010-05", "null"))], "event_id string, fix struct<time_start:string,time_end:string>")
    got = {r.event_id: (r.time_start, r.time_end, r.status) for r in validate.validate(e, fixes).collect()}
    assert got == {"1": ("2008", None, "rule_fixed"), "2": ("2008", "2009-01-02", "rule_fixed"), "3": ("2010-05", None, "llm_fixed"), "4": ("2001", "null", "valid")}


def test_overlap_depends_on_order(spark):
    def merged(times):
        rows = [(f"e{k}", k, "d", " Same ", "point", t, None, f"c{k % 2}") for k, t in enumerate(times)]
        df = spark.createDataFrame(rows, "event_id string, ord long, doc_id string, event_description string, time_type string, time_start string, time_end string, chunk_id string")
        return sorted((r.time_start, r.n_merged) for r in dedupe.overlapping(df).collect())

    assert merged(["2008", "2008-07", "2008-08"]) == [("2008-07", 3)]
    assert merged(["2008-07", "2008-08", "2008"]) == [("2008-07", 2), ("2008-08", 1)]


def test_greedy_clusters():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [0.7, 0.7]])
    assert cluster.greedy(np.arange(5), x, 0.9).tolist() == [0, 0, 1, 1, 2]


def test_windows_and_neighbours(spark):
    c = spark.createDataFrame([(f"d-chunk-{k:04d}", "d", k, [k]) for k in (0, 1, 3, 4, 5)], "chunk_id string, doc_id string, chunk_index int, events array<int>")
    got = provenance.surrounding(c, c, 2, 2).groupBy("centre").agg(F.sort_array(F.collect_list("chunk_index")).alias("n"))
    assert {r.centre[-1]: r.n for r in got.collect()} == {"0": [0, 1], "1": [0, 1], "3": [3, 4, 5], "4": [3, 4, 5], "5": [3, 4, 5]}
    six = spark.createDataFrame([("d", k, [k]) for k in range(6)], "doc_id string, chunk_index int, events array<int>")
    prior = {r.chunk_index: r.prior for r in timeline.prior_events(six, "sliding", 3).collect()}
    assert prior[5] == [0, 2, 3, 4] and prior[4] == [0, 1, 2, 3] and prior[0] == []


def test_vectors(spark):
    v = spark.createDataFrame([(k, k, [float(np.cos(k)), float(np.sin(k))]) for k in range(120)], "node_id long, ord long, embedding array<float>")
    exact = [r.node_id for r in semantic.flat_search(v, [1.0, 0.0], 5).collect()]
    found = [r.node_id for r in semantic.IvfIndex(v).search([1.0, 0.0], 5).collect()]
    assert exact[0] == 0 and len(set(exact) & set(found)) >= 4
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    e = semantic.hashing_embedder(8)
    assert abs(one(spark, V.norm(e(F.lit("some words here")))) - 1) < 1e-6


def test_questions():
    q = questions.parse("Which team did Thierry Audel play for in 2013?")
    assert (q.question_stem, q.time_constraint.normalized_time, q.event_type, q.answer_type) == ("Which team did Thierry Audel play for?", "2013", "interval", "entity")
    q = questions.parse("Which team did A B play for between Apr 1987 and Nov 1988?")
    assert q.time_constraint.normalized_time == "1987-04/1988-11"
    assert questions.parse("How many goals did he score?").time_constraint.constraint_type == "none"
    plan = questions.plan("Who led Rome in 1990?")
    assert [t.tool for t in plan.subtasks] == ["Search", "Python", "Python", "NULL"] and plan.total_tasks == 4


def test_plan_runs_on_whole_tables(spark):
    events = spark.createDataFrame([("a", "1989", "1991"), ("b", "1990-05", None), ("c", "2001", None)], "event_description string, time_start string, time_end string")
    done = questions.execute(questions.plan("How many wars were there in 1990?"), lambda q: events)
    assert done["success"] and done["final"].first().value == 2
    broken = questions.Plan("q", {}, [questions.Task("t", "", "Python", {"op": "filter"}, ["nowhere"])], 1, "")
    assert not questions.execute(broken, lambda q: events)["success"]


def test_pipeline_and_graph_files(spark, tmp_path):
    text = "Ada Lovelace was born in 1815. She met Charles Babbage in 1833. Ada Lovelace wrote notes from 1842 to 1843. Nothing here."
    docs = spark.createDataFrame([("d0", "Ada", text)], "doc_id string, title string, content string")
    p = extraction.Pipeline(spark, Config(data_dir=str(tmp_path / "run")))
    out = p.run(docs)
    assert out["filter"].count() == 3 and out["timeline"].count() == 1
    again = p.run(start="timeline")
    g = Graph(**{k[6:]: v for k, v in again.items() if k.startswith("graph_")})
    assert {r.type: r.n for r in g.stats().where("type is not null").collect()}["timeline"] == 1
    files.graph_to_json(g, str(tmp_path / "g"))
    back = files.graph_from_folders(spark, str(tmp_path / "g"))
    counts = lambda h: {(r.kind, r.type): r.n for r in h.stats().collect()}
    assert counts(back) == counts(g)
    files.graph_to_graphml(g, str(tmp_path / "g.graphml"))
    assert counts(files.graph_from_graphml(spark, str(tmp_path / "g.graphml"))) == counts(g)
    reply = Replay(spark.createDataFrame([("d0-chunk-0000", "no json")], "request_id string, response string"))
    assert extraction.events(out["chunk"], reply).count() == 0


def test_sources(spark, tmp_path):
    rows = [{"doc_id": "1", "title": "t", "content": "c", "source_idx": "0"}, {"doc_id": "2", "title": "u", "content": "d", "source_idx": "1"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"documents": rows}))
    for name in ("a.json", "b.json"):
        assert [r.doc_id for r in files.documents(spark, str(tmp_path / name)).orderBy("ord").collect()] == ["1", "2"]
        assert files.documents(spark, str(tmp_path / name), 1).first().doc_id == "2"
    files.write_stage(spark.range(3), files.stage_path(str(tmp_path), "event", "test"))
    assert files.read_stage(spark, str(tmp_path), "test").count() == 3
    c = Config.from_dict(COMPACT)
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c and Config.load(str(tmp_path / "none.json")) == Config()


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, make, mode in (("spans", timeline_spans, "complete"), ("first", lambda s: distinct_events(s, ["event_id"], "400 days"), "append")):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("first").count() == src.select("event_id").distinct().count()
    want = {(r.user_id, r.event_type): r.n for r in timeline_spans(src).collect()}
    assert {(r.user_id, r.event_type): r.n for r in spark.table("spans").collect()} == want
    assert windowed_counts(src).count() > 0
