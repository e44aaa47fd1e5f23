"""Relations and timelines by a provider, files of questions and events, and the commands on them."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave import cli
from chronoweave.functions import stem
from chronoweave.operators import relations
from chronoweave.plans import timelines
from chronoweave.plans.providers import Replay, Rules
from chronoweave.sources import files

EVENTS = "event_id string, ord long, event_description string, entity_names array<string>, time_start string, time_end string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [("e1", 0, "Ada met Babbage", ["Ada", "Babbage"], "1833", None), ("e2", 1, "", ["Ada"], "1840", None), ("e3", 2, "Ada wrote", [], "1843", None), ("e4", 3, "Ada and Mary spoke", ["Ada", "Mary", "Babbage"], "1850", "1851")]
    return spark.createDataFrame(rows, EVENTS)


def test_structurise_by_rule(events):
    got = {r.relation_id: (r.subject, r.object_entity, r.time_start, r.confidence, r.source_event_ids) for r in relations.structurise(events, Rules(relations.by_rule())).collect()}
    assert got == {"e1-rel-0": ("Ada", "Babbage", "1833", 1.0, ["e1"]), "e4-rel-0": ("Ada", "Mary", "1850", 1.0, ["e4"]), "e4-rel-1": ("Ada", "Babbage", "1850", 1.0, ["e4"])}
    assert relations.structurise(events, Rules(F.lit("no json"))).count() == 0
    assert relations.structurise(events.limit(0), Rules(relations.by_rule())).count() == 0


def test_structurise_in_batches(events):
    one = Rules(F.lit('{"relations": [{"relation_type": "knows", "subject": "Ada", "object_entity": "Mary"}]}'))
    rows = relations.structurise_in_batches(events, one, size=2, shards=1).collect()
    assert sorted(r.source_event_ids for r in rows) == [["e1", "e2"], ["e3", "e4"]]
    assert {(r.relation_type, r.confidence, r.time_start) for r in rows} == {("knows", 1.0, None)}


def test_relevance(spark, events):
    rel = relations.structurise(events, Rules(relations.by_rule()))
    ids = lambda df: sorted(r.relation_id for r in df.collect())
    answer = lambda text: Replay(spark.createDataFrame([("filter", text)], "request_id string, response string"))
    assert ids(relations.keep_relevant(rel, answer('{"relevant_indices": [2, 0, 2, 9]}'))) == ["e1-rel-0", "e4-rel-1"]
    assert ids(relations.keep_relevant(rel, answer("broken"))) == ids(rel) == ids(relations.keep_relevant(rel, None))
    assert ids(relations.in_time(rel, "1840", "1850")) == ["e4-rel-0", "e4-rel-1"]


def test_timelines_batch_by_batch(spark):
    rows = [("Ada", f"e{k}", k, f"event {k}", str(1800 + k), None) for k in range(5)] + [("Mary", "m1", 9, "alone", "1850", None)]
    mentions = spark.createDataFrame(rows, "entity string, event_id string, ord long, event_description string, time_start string, time_end string")
    seen = F.get_json_object("prompt", "$.timelines")
    ids = F.transform(F.from_json(F.get_json_object("prompt", "$.events"), "array<struct<event_id:string>>"), lambda x: x["event_id"])
    line = F.struct(F.lit("life").alias("timeline_id"), F.when(seen.isNull(), "Life").otherwise("Other").alias("timeline_name"), F.lit("").alias("description"), F.slice(ids, 1, 1).alias("event_ids"))
    alone = F.transform(F.slice(ids, 2, 9), lambda x: F.struct(x.alias("event_id"), F.lit("none").alias("reason")))
    lines, rest = timelines.iterative(mentions, Rules(F.to_json(F.struct(F.array(line).alias("timelines"), alone.alias("standalone_events")))), size=2)
    (r,) = lines.collect()
    assert (r.entity, r.timeline_name, r.event_ids, r.time_span_start, r.time_span_end) == ("Ada", "Life", ["e0", "e2", "e4"], "1800", "1804")
    assert sorted((x.entity, x.event_id) for x in rest.collect()) == [("Ada", "e1"), ("Ada", "e3"), ("Mary", "m1")]
    once, _ = timelines.single_shot(mentions, Replay(spark.createDataFrame([("Ada", '{"timelines": [{"timeline_name": "L", "description": "", "event_ids": ["e1", "e3"]}], "standalone_events": []}')], "request_id string, response string")))
    assert [(x.timeline_id, x.time_span_end) for x in once.collect()] == [("timeline-0000", "1803")]


def test_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"original_question": "When?", "question_stem": "When", "time_constraint": {"constraint_type": "none"}, "event_type": "point", "answer_type": "time"}))
    assert files.question(spark, str(tmp_path / "q.json")).first().answer_type == "time"
    (tmp_path / "bad.json").write_text("{")
    assert files.question(spark, str(tmp_path / "bad.json")) is None and files.question(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "e.json").write_text(json.dumps([{"event_id": "a", "time_start": "2008-7", "time_type": "point", "event_description": "x"}, {"event_id": "b", "time_start": "2008-07", "time_type": "point", "event_description": "x"}]))
    assert files.events(spark, str(tmp_path / "e.json")).count() == 2
    with pytest.raises(ValueError):
        files.graph_from_json(spark, str(tmp_path / "g.txt"))
    with pytest.raises(FileNotFoundError):
        files.graph_from_json(spark, str(tmp_path / "g.json"))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "e.json").write_text(json.dumps([{"event_id": "a", "time_start": "2008-7", "time_type": "point", "event_description": "x"}]))
    cli.main(["validate", str(tmp_path / "e.json"), "-o", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).first().time_start == "2008-07"
    cli.main(["--json", "filter", str(tmp_path / "e.json")])
    assert '"event_id":"a"' in capsys.readouterr().out
    cli.main(["generate", "Who met Babbage?"])
    assert "event_queries" in capsys.readouterr().out


def test_stems(spark):
    words = ["running", "walked", "cities", "trees", "relational", "kindness", "glass", "éclairs", "was"]
    got = [r.s for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").select("k", stem.stem(F.col("w")).alias("s")).orderBy("k").collect()]
    assert got == ["run", "walk", "citi", "tree", "relat", "kind", "glass", "éclairs", "wa"]
    assert "the" in stem.STOP_WORDS and len(set(stem.STOP_WORDS)) == len(stem.STOP_WORDS)


def test_stems_of_the_published_examples(spark):
    pairs = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
    happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
    radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
    feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
    triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
    allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
    replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
    angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control
    roll roll generalizations gener oscillators oscil died die spied spi flies fli enjoy enjoy cry cri by by dying die proceed proceed
    toy toy geology geolog skies sky""".split()
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([*pairs[::2], "", None])], "k int, w string")
    got = [r.s for r in rows.select("k", stem.stem(F.col("w")).alias("s")).orderBy("k").collect()]
    assert got == [*pairs[1::2], "", None]
