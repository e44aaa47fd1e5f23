"""Questions by rule: time constraint, kinds, retrieval queries, and a plan of typed steps."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WHEN = rf"(?:(?:\d{{1,2}}\s+)?(?:{_MONTH})\.?\s+(?:\d{{1,2}},?\s+)?)?\d{{4}}"
_EXPLICIT = re.compile(rf"(?i)\b(?:(?P<two>between|from)\s+(?P<a>{_WHEN})\s+(?:and|to|until|-)\s+(?P<b>{_WHEN})|(?P<one>in|on|during|before|after|since|by|until|as of)\s+(?P<c>{_WHEN}))\b")
_IMPLICIT = re.compile(r"(?i)\b(?:during|when|while|after|before|since)\s+(?!\d)[^?.,]+")
_NUMBER = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_POINT = re.compile(r"(?i)\b(born|birth|die[ds]?|death|won|win|award|sign(?:ed)?|appointed|elected|founded|married)\b")
_INTERVAL = re.compile(r"(?i)\b(serve[ds]?|play(?:ed)?|work(?:ed)?|live[ds]?|held|hold|position|member|coach|manage[ds]?|attend(?:ed)?|study|studied|team|spouse)\b")


@dataclass
class TimeConstraint:
    constraint_type: str = "none"
    original_expression: str = ""
    normalized_time: str | None = None
    description: str = "No time constraint"


@dataclass
class Question:
    original_question: str
    question_stem: str
    time_constraint: TimeConstraint = field(default_factory=TimeConstraint)
    event_type: str = "point"
    answer_type: str = "entity"


def normal_time(text: str) -> str:
    """YYYY, YYYY-MM or YYYY-MM-DD."""
    year = re.search(r"\d{4}", text)[0]
    month = re.search(rf"(?i)({_MONTH})", text)
    if not month:
        return year
    day = re.search(r"\b(\d{1,2})\b(?!\d)", text.replace(year, ""))
    out = f"{year}-{_NUMBER[month[0][:3].lower()]:02d}"
    return f"{out}-{int(day[1]):02d}" if day else out


def parse(question: str, enabled: bool = True) -> Question:
    """Disabled, the question is its own stem."""
    text = question.strip()
    if not enabled:
        return Question(question, text)
    limit = TimeConstraint()
    if m := _EXPLICIT.search(text):
        times = [normal_time(x) for x in (m["a"], m["b"], m["c"]) if x]
        limit = TimeConstraint("explicit", m[0], "/".join(times) if len(times) > 1 else times[0], f"{(m['two'] or m['one']).lower()} {' and '.join(times)}")
    elif m := _IMPLICIT.search(text[1:]):
        limit = TimeConstraint("implicit", m[0].strip(), None, f"The period named by: {m[0].strip()}")
    stem = re.sub(r"\s+([?.!,])", r"\1", re.sub(r"\s{2,}", " ", text.replace(limit.original_expression, ""))).strip(" ,") if limit.original_expression else text
    low = text.lower()
    kind = "time" if re.match(r"(when|(?:in )?(what|which) (year|month|date|day)|how long)\b", low) else "number" if re.match(r"how (many|much)|what (number|rank)\b", low) else "boolean" if re.match(r"(did|was|is|are|were|has|have|does|do|can)\b", low) else "entity" if re.match(r"(who|whom|whose|where|which|what)\b", low) else "other"
    return Question(question, stem, limit, "point" if _POINT.search(low) and not _INTERVAL.search(low) else "interval" if _INTERVAL.search(low) else "point", kind)


def retrieval_queries(text: str) -> dict:
    return {"entity_query": text, "timeline_query": text, "event_queries": [text]}


@dataclass
class Task:
    """tool: Search (params: query), Python (params: op and its arguments), NULL (the answer)."""

    task_id: str
    question: str
    tool: str
    tool_params: dict = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)
    reasoning: str = ""


@dataclass
class Plan:
    original_query: str
    query_analysis: dict
    subtasks: list[Task]
    total_tasks: int
    timestamp: str


def plan(question: str | Question) -> Plan:
    """Search, filter by the time, reduce to what is asked for, answer."""
    q = parse(question) if isinstance(question, str) else question
    tasks = [Task("task-001", f"Find events about: {q.question_stem}", "Search", {"query": q.question_stem})]
    last = lambda: tasks[-1].task_id
    if q.time_constraint.constraint_type == "explicit":
        times = q.time_constraint.normalized_time.split("/")
        word = q.time_constraint.original_expression.split()[0].lower()
        lo, hi = (None, times[0]) if word in ("before", "until", "by") else (times[0], None) if word in ("after", "since") else (times[0], times[-1])
        tasks.append(Task("task-002", f"Keep those {q.time_constraint.original_expression}", "Python", {"op": "filter_time", "start": lo, "end": hi}, [last()]))
    elif q.time_constraint.constraint_type == "implicit":
        tasks.append(Task("task-002", f"Find the period of: {q.time_constraint.original_expression}", "Search", {"query": q.time_constraint.original_expression}))
        tasks.append(Task("task-003", "Keep events that overlap with it", "Python", {"op": "overlap"}, ["task-001", "task-002"]))
    op = {"number": {"op": "aggregate", "fn": "count"}, "time": {"op": "extract", "column": "time_start"}, "boolean": {"op": "aggregate", "fn": "count"}}.get(q.answer_type, {"op": "extract", "column": "event_description"})
    tasks.append(Task(f"task-{len(tasks) + 1:03d}", "Reduce to what is asked for", "Python", op, [last()]))
    tasks.append(Task(f"task-{len(tasks) + 1:03d}", "Answer", "NULL", {}, [last()]))
    return Plan(q.original_question, asdict(q), tasks, len(tasks), datetime.now(UTC).isoformat())


# Typed operations in the place of generated programs


def _bounds(df: DataFrame) -> DataFrame:
    from ..functions import temporal as T

    s, e = T.parse("time_start"), T.parse("time_end")
    return df.withColumn("_s", s).withColumn("_e", e).withColumn("lo", T.first_day("_s")).withColumn("hi", F.coalesce(T.last_day("_e"), T.last_day("_s"))).drop("_s", "_e")


def filter_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose interval meets [start, end]; a missing bound is open."""
    from ..functions import temporal as T

    cond = F.lit(True)
    if end:
        cond = cond & (F.col("lo") <= T.last_day(T.parse(F.lit(end))))
    if start:
        cond = cond & (F.col("hi") >= T.first_day(T.parse(F.lit(start))))
    return _bounds(df).where(cond).drop("lo", "hi")


def overlap(df: DataFrame, period: DataFrame) -> DataFrame:
    """Rows that meet the whole span of the other table; one row of bounds is broadcast."""
    span = _bounds(period).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    return _bounds(df).crossJoin(F.broadcast(span)).where((F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))).drop("lo", "hi", "_lo", "_hi")


def compare(a: DataFrame, b: DataFrame, sign: str = "=") -> DataFrame:
    """a, b, value: two results of one row each compared; more rows are an error, not a product."""
    if sign not in ("=", "<", ">", "<=", ">=", "<>"):
        raise ValueError(f"no such comparison: {sign}")
    one = lambda df, name: df.agg(F.when(F.count(F.lit(1)) > 1, F.raise_error("a comparison needs one row on each side")).otherwise(F.first("value")).alias(name))
    return one(a, "a").crossJoin(F.broadcast(one(b, "b"))).select("a", "b", F.expr(f"a {sign} b").alias("value"))


AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}
OPERATIONS = {
    "filter_time": lambda inputs, p: filter_time(inputs[0], p.get("start"), p.get("end")),
    "overlap": lambda inputs, p: overlap(*inputs[:2]),
    "filter": lambda inputs, p: inputs[0].where(p["condition"]),
    "extract": lambda inputs, p: inputs[0].select(p["column"]),
    "aggregate": lambda inputs, p: inputs[0].agg(AGGREGATES[p["fn"]](F.col(p["column"]) if "column" in p else None).alias("value")),
    "earliest": lambda inputs, p: inputs[0].orderBy(F.col("time_start").asc_nulls_last()).limit(1),
    "compare": lambda inputs, p: compare(*inputs[:2], p.get("sign", "=")),
    "transform": lambda inputs, p: inputs[0].withColumn(p["name"], F.expr(p["expression"])),
    "mentions": lambda inputs, p: inputs[0].where(F.lower("event_description").contains(str(p["text"]).lower())),
}


def execute(made: Plan, search) -> dict:
    """Tasks in their order; search: query to a DataFrame of events. A task that lacks an input or fails ends the run; the
    last result is the answer. Results stay DataFrames: nothing is computed until they are read."""
    results: dict[str, DataFrame] = {}
    status: list[dict] = []
    for t in made.subtasks:
        began = datetime.now(UTC)
        try:
            missing = [d for d in t.depends_on if d not in results]
            if missing:
                raise ValueError(f"{t.task_id} needs {', '.join(missing)}")
            inputs = [results[d] for d in t.depends_on]
            tool = t.tool.lower()
            if tool == "search":
                results[t.task_id] = search(t.tool_params["query"])
            elif tool == "python":
                results[t.task_id] = OPERATIONS[t.tool_params["op"]](inputs, t.tool_params)
            else:
                results[t.task_id] = inputs[-1]
            status.append({"task_id": t.task_id, "success": True, "error": None, "seconds": (datetime.now(UTC) - began).total_seconds()})
        except Exception as e:  # a failed task is a result of the run
            status.append({"task_id": t.task_id, "success": False, "error": str(e), "seconds": (datetime.now(UTC) - began).total_seconds()})
            break
    done = [s["task_id"] for s in status if s["success"]]
    return {"success": len(done) == len(made.subtasks), "final": results[done[-1]] if done else None, "results": results, "status": status}
