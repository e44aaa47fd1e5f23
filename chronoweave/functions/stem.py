"""English stop words, and Porter's stemmer (1980) as a column function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import _let

# Function words that carry no topic.
STOP_WORDS = (
    "a about after all also an and any are as at be been before being between both but by can could did do does during each "
    "few for from had has have he her here him his how i if in into is it its just may me more most my no nor not of off on "
    "once only or other our out over own same she should so some such than that the their them then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()

# Words that the rules would spoil, with what they become.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# The endings of steps 2, 3 and 4, in the order in which they are tried, and what they become.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# What begins a stem: consonants or none, then as many times a run of vowels before consonants as its measure says. A y
# is a consonant at the start and after a vowel.
_HEAD = "^(?:[^aeiou][^aeiouy]*|(?=[aeiou]))"
_PAIR = "[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
_SOME, _MANY = f"{_HEAD}{_PAIR}", f"{_HEAD}{_PAIR}{_PAIR}"
_ONE = f"{_HEAD}{_PAIR}(?:[aeiouy][aeiou]*)?$"
_VOWEL = "[aeiou]|(?<=[^aeiou])y"
_SHORT = "(?:(?:[^aeiouy]|(?<=[aeiou])y|^y)[aeiouy][^aeiouwxy]|^[aeiou][^aeiou])$"


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _first(word: Column, rules: list[tuple[str, Column]]) -> Column:
    """The value beside the first ending that the word has; the word, if it has none."""
    out = word
    for ending, value in reversed(rules):
        out = F.when(word.endswith(ending), value).otherwise(out)
    return out


def _put(word: Column, ending: str, put: str, pattern: str) -> Column:
    """The word with the ending replaced, if what is before it fits the pattern."""
    base = _cut(word, len(ending))
    return F.when(base.rlike(pattern), F.concat(base, F.lit(put))).otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("ies") & (F.length(w) == 4), _cut(w, 1)).otherwise(
        _first(w, [("sses", _cut(w, 2)), ("ies", _cut(w, 2)), ("ss", w), ("s", _cut(w, 1))]))


def _mended(w: Column) -> Column:
    """A word that has lost -ed or -ing."""
    double = w.rlike(r"([^aeiouy])\1$")
    single = F.when(w.rlike("[lsz]$"), w).otherwise(_cut(w, 1))
    short = F.when(w.rlike(_ONE) & w.rlike(_SHORT), F.concat(w, F.lit("e"))).otherwise(w)
    return F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(double, single).otherwise(short)


def _past(w: Column) -> Column:
    left = lambda n: F.when(_cut(w, n).rlike(_VOWEL), _let(_cut(w, n), _mended)).otherwise(w)
    ied = F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2))
    return _first(w, [("ied", ied), ("eed", _put(w, "eed", "ee", _SOME)), ("ed", left(2)), ("ing", left(3))])


def _y(w: Column) -> Column:
    return F.when(w.rlike("^..*[^aeiouy]y$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _second(w: Column) -> Column:
    """Where -alli becomes -al, the rules are tried once more."""
    rules = lambda x: _first(x, [(e, F.when(_cut(x, 3).rlike(_SOME), _cut(x, 1)).otherwise(x) if e == "logi" else _put(x, e, to, _SOME)) for e, to in STEP_2])
    return _let(F.when(w.endswith("alli"), _put(w, "alli", "al", _SOME)).otherwise(w), rules)


def _third(w: Column) -> Column:
    return _first(w, [(e, _put(w, e, to, _SOME)) for e, to in STEP_3])


def _fourth(w: Column) -> Column:
    ion = F.when(_cut(w, 3).rlike(_MANY) & w.rlike("[st]ion$"), _cut(w, 3)).otherwise(w)
    return _first(w, [(e, ion if e == "ion" else _put(w, e, "", _MANY)) for e in STEP_4])


def _last(w: Column) -> Column:
    base = _cut(w, 1)
    bare = base.rlike(_MANY) | (base.rlike(_ONE) & ~base.rlike(_SHORT))
    return F.when(w.endswith("e") & bare, base).when(w.endswith("ll") & base.rlike(_MANY), base).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word by Porter's rules, with the usual mendings (irregular words; -ies and -ied of four
    letters; -y after a consonant; -bli, -fulli, -logi). Words of one or two letters, and words with other characters
    than a-z, are left as they are; null stays null."""
    out = word
    for step in (_plural, _past, _y, _second, _third, _fourth, _last):
        out = _let(out, step)
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.when(word.rlike("^[a-z]{3,}$"), F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == word)), F.lit(0)), out)).otherwise(word)
