"""Retrieval over a small graph, and the command line."""

import pytest

from chronoweave import cli
from chronoweave.config import Config
from chronoweave.operators.graph import Graph
from chronoweave.operators.retrieve import Retriever
from chronoweave.sources import files


@pytest.fixture(scope="module")
def graph(spark):
    f = spark.createDataFrame
    return Graph(
        f([("Ada", 0, "mathematician", ["A. Lovelace"]), ("Babbage", 1, "engineer", [])], "name string, ord long, description string, aliases array<string>"),
        f([("e1", 0, "Ada wrote notes on the engine", "1843", ""), ("e2", 1, "Babbage drew the engine", "1837", ""), ("e3", 2, "Ada was born", "1815", "")], "event_id string, ord long, event_description string, time_start string, time_end string"),
        f([("t1", 0, "Life of Ada", "", "Ada", ["e3", "e1"])], "timeline_id string, ord long, timeline_name string, description string, entity_canonical_name string, event_ids array<string>"),
        f([("Ada", "e1", "participant", 0), ("Babbage", "e2", "participant", 1), ("Ada", "e3", "participant", 2)], "name string, event_id string, role string, ord long"),
        f([("e3", "t1", 0, 0), ("e1", "t1", 1, 1)], "event_id string, timeline_id string, position int, ord long"),
        f([("Ada", "t1", 0)], "name string, timeline_id string, ord long"),
    )


def test_modes(graph):
    r = Retriever(graph, Config())
    for mode in ("keyword", "hybrid"):
        assert r.search("notes on the engine", 1, "event", mode).first().node_id == "e1"
    assert r.search("Ada", 5).count() == 5
    best = r.vote("Ada notes", 3, details=True).collect()
    assert best[0].event_id in ("e1", "e3") and best[0].vote_count >= 3
    found = r.hierarchical("Ada", k1=1)
    assert [x.name for x in found["entities"].collect()] == ["Ada"]
    assert {x.event_id for x in found["events"].collect()} == {"e1", "e3"}
    assert found["timelines"].first().source_entity_names == ["Ada"]
    assert r.in_entity("born", "lovelace").first().node_id == "e3"
    many = r.many({"entity_query": "Ada", "timeline_query": "Ada", "event_queries": ["engine drew"]}, event_k=1)
    assert [x.event_id for x in many["merged"].orderBy("place").collect()] == ["e2", "e3", "e1"]


def test_command_line(graph, spark, tmp_path, capsys):
    files.graph_to_json(graph, str(tmp_path / "g"))
    cli.main(["--json", "graph", str(tmp_path / "g"), "entity-events", "Ada"])
    assert capsys.readouterr().out.count("event_id") == 2
    cli.main(["plan", "Who wrote notes in 1843?"])
    assert "filter_time" in capsys.readouterr().out
