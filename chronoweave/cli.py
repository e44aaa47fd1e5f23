"""Command line: python -m chronoweave.cli <command> ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from .config import Config
from .operators import dedupe, validate
from .operators.graph import Graph
from .operators.retrieve import Retriever
from .plans import questions
from .session import session
from .sources import files


def _show(df: DataFrame, as_json: bool, n: int = 50) -> None:
    if as_json:
        for row in df.limit(n).toJSON().toLocalIterator():
            print(row)
    else:
        df.show(n, truncate=100)


def _graph(spark, path: str) -> Graph:
    if path.endswith(".graphml"):
        return files.graph_from_graphml(spark, path)
    return files.graph_from_json(spark, path) if path.endswith(".json") else files.graph_from_folders(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoweave")
    p.add_argument("--config")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("pipeline")
    run.add_argument("corpus")
    for flag, default in (("--split", "test"), ("--start", "chunk"), ("--end", "graph"), ("--data-dir", None)):
        run.add_argument(flag, default=default)
    run.add_argument("--doc-index", type=int)
    g = sub.add_parser("graph")
    g.add_argument("path")
    g.add_argument("what", choices=["stats", "entities", "events", "timelines", "entity", "entity-events", "entity-timelines", "event", "timeline", "search", "time"])
    g.add_argument("args", nargs="*")
    s = sub.add_parser("search")
    s.add_argument("path")
    s.add_argument("query")
    s.add_argument("-k", type=int)
    s.add_argument("-t", "--target", default="all", choices=["all", "entity", "event", "timeline"])
    s.add_argument("--mode", default="hybrid", choices=["hybrid", "keyword", "semantic", "voting", "voting-details", "hierarchical", "entity"])
    s.add_argument("--fusion")
    s.add_argument("--entity")
    for name in ("parse", "plan", "generate"):
        sub.add_parser(name).add_argument("question")
    for name in ("validate", "filter"):
        one = sub.add_parser(name)
        one.add_argument("events")
        one.add_argument("-o", "--output")
    done = sub.add_parser("execute")
    done.add_argument("path")
    done.add_argument("plan_file")
    near = sub.add_parser("chunks")
    near.add_argument("path")
    near.add_argument("query")
    near.add_argument("--chunks", required=True)
    near.add_argument("--before", type=int, default=0)
    near.add_argument("--after", type=int, default=0)
    near.add_argument("-k", type=int, default=5)
    ask = sub.add_parser("query")
    ask.add_argument("path")
    ask.add_argument("question")
    return p


def _standalone(spark, a) -> None:
    """validate and filter: a file of events in, the table shown, or written as JSON lines to -o."""
    rows = files.events(spark, a.events)
    out = validate.validate(rows) if a.command == "validate" else dedupe.overlapping(rows)
    if a.output:
        out.write.mode("overwrite").json(a.output)
    else:
        _show(out, a.json)


def _task_plan(row) -> questions.Plan:
    """A saved plan; parameters of its tasks are texts."""
    tasks = [questions.Task(t.task_id, t.question or "", t.tool, dict(t.tool_params or {}), list(t.depends_on or []), t.reasoning or "") for t in row.subtasks]
    return questions.Plan(row.original_query, {}, tasks, len(tasks), row.timestamp)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command in ("parse", "plan", "generate"):
        made = {"parse": lambda q: asdict(questions.parse(q)), "plan": lambda q: asdict(questions.plan(q)), "generate": lambda q: questions.retrieval_queries(questions.parse(q).question_stem)}[a.command](a.question)
        print(json.dumps(made, indent=2, ensure_ascii=False))
        return
    spark, config = session(), Config.load(a.config)
    if a.command in ("validate", "filter"):
        _standalone(spark, a)
        return
    if a.command == "pipeline":
        from .plans.extraction import Pipeline

        config.data_dir = a.data_dir or config.data_dir
        docs = files.documents(spark, a.corpus, a.doc_index) if a.start == "chunk" else None
        for name, df in Pipeline(spark, config, split=a.split).run(docs, a.start, a.end).items():
            print(name, df.count())
        return
    graph = _graph(spark, a.path)
    if a.command == "graph":
        first = a.args[0] if a.args else ""
        named = lambda: e if (e := graph.entity(first)).limit(1).count() else graph.entities_by_name(first, fuzzy=True)
        made = {
            "stats": graph.stats, "entities": lambda: graph.keys("entity"), "events": lambda: graph.keys("event"), "timelines": lambda: graph.keys("timeline"),
            "entity": named, "entity-events": lambda: graph.entity_events(named()), "entity-timelines": lambda: graph.entity_timelines(named()),
            "event": lambda: graph.event(first), "timeline": lambda: graph.timeline_events(graph.timeline(first)).orderBy("position"),
            "search": lambda: graph.entities_by_name(first, fuzzy=True), "time": lambda: graph.events_in_years(*(a.args + [None, None])[:2]),
        }[a.what]()
        _show(made, a.json)
        return
    r = Retriever(graph, config)
    if a.command == "search":
        if a.mode == "hierarchical":
            for name, df in r.hierarchical(a.query).items():
                print(name)
                _show(df, a.json)
            return
        out = r.in_entity(a.query, a.entity, a.k) if a.mode == "entity" else r.vote(a.query, a.k, a.fusion, a.mode == "voting-details") if a.mode.startswith("voting") else r.search(a.query, a.k, a.target, a.mode, a.fusion)
        _show(out, a.json)
        return

    if a.command == "chunks":
        _show(r.chunks(a.query, files.read_chunks(spark, a.chunks), a.k, a.before, a.after), a.json)
        return

    def found(query: str) -> DataFrame:
        hits = r.search(query, 20, "event").select("node_id")
        return graph.events.join(hits, graph.events["event_id"].cast("string") == hits["node_id"], "left_semi")

    made = questions.plan(a.question) if a.command == "query" else _task_plan(files.last_plan(spark, a.plan_file).first())
    done = questions.execute(made, found)
    print(json.dumps(done["status"], indent=2))
    if done["final"] is not None:
        _show(done["final"], a.json)


if __name__ == "__main__":
    main()
