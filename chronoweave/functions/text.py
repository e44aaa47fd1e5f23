"""Texts: tokens, searchable forms, identifiers, JSON in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that begin questions, and verb phrases, by which a text is told from the name of one entity.
QUESTION_WORDS = ["who", "what", "where", "when", "why", "how", "which", "did", "does", "is", "are", "was", "were", "has", "have", "can", "could", "would", "should", "will", "shall"]
VERB_PHRASES = [r"\bplay(?:ed)?\s+for\b", r"\bwork(?:ed)?\s+at\b", r"\bserve(?:d)?\s+as\b", r"\bjoined?\b", r"\bmarried\s+to\b", r"\bheld?\b", r"\bbecame\b", r"\bwon\b", r"\bscore(?:d)?\b"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c, *, stopwords: list[str] = (), stem=None, least: int = 2) -> Column:
    """Lower-cased runs of word characters (of any script) with `least` characters or more; stem: a column function."""
    out = F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)[a-z0-9_\w]++"), F.lit(0)), lambda x: F.length(x) >= least)
    if stopwords:
        out = F.filter(out, lambda x: ~x.isin(*stopwords))
    return F.transform(out, stem) if stem else out


def joined(sep: str, *parts) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(sep, *[F.nullif(_col(p), F.lit("")) for p in parts])


def entity_text(name="canonical_name", description="description", aliases="aliases") -> Column:
    return F.concat_ws(" ", _col(name), _col(description), F.array_join(_col(aliases), " "))


def event_text(description="event_description", expression="time_expression", sentence="original_sentence", names="entity_names") -> Column:
    return F.concat_ws(" ", _col(description), _col(expression), _col(sentence), F.array_join(_col(names), " "))


def timeline_text(name="timeline_name", description="description", entity="entity_canonical_name") -> Column:
    return F.concat_ws(" ", _col(name), _col(description), _col(entity))


def embed_text(*parts) -> Column:
    return F.concat_ws("|", *[_col(p) for p in parts])


def disambiguation_text(name, description, weight: float) -> Column:
    """The name, as often as the weight says, a full stop, and the description."""
    return F.trim(F.concat(F.array_join(F.array_repeat(_col(name), int(weight)), " "), F.lit(". "), F.coalesce(_col(description), F.lit(""))))


def is_single_entity(c) -> Column:
    """A short text without question mark, question word or verb phrase."""
    low = F.lower(F.trim(_col(c)))
    words = F.filter(F.split(low, r"\s+"), lambda x: x != "")
    verbs = F.lit(False)
    for v in VERB_PHRASES:
        verbs = verbs | low.rlike(v)
    return ~_col(c).contains("?") & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in QUESTION_WORDS])) & ~verbs & (F.size(words) <= 10)


def numbered(prefix, kind: str, n) -> Column:
    """prefix-kind-0007; longer numbers are not cut."""
    return F.format_string(f"%s-{kind}-%04d", _col(prefix), _col(n))


def chunk_doc(c) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^(?s:(.*))-chunk-(\d+)$", 1), F.lit(""))


def chunk_number(c) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^(?s:.*)-chunk-(\d+)$", 1), F.lit("")).cast("int")


def answer(c, ddl: str) -> Column:
    """A JSON answer, plain or within a code fence; null where neither parses."""
    c = _col(c)
    plain = F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, ddl))
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(plain, F.when(F.get_json_object(fenced, "$").isNotNull(), F.from_json(fenced, ddl)))


def relation_text(kind="relation_type", subject="subject", obj="object_entity", start="time_start", end="time_end") -> Column:
    """type(subject, object[, start[, end]]); an end without a start is left out."""
    inner = F.concat_ws(", ", _col(subject), _col(obj), F.nullif(_col(start), F.lit("")), F.when(F.nullif(_col(start), F.lit("")).isNotNull(), F.nullif(_col(end), F.lit(""))))
    return F.concat(_col(kind), F.lit("("), inner, F.lit(")"))
