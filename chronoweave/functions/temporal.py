"""Partial dates: year, year and month, or a full day, as struct<year:int,month:int,day:int>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<year:int,month:int,day:int>"
#: Unicode's White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named: the optimiser substitutes projections into
    filters, and deep date expressions would multiply there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(_col(c), F.lit(WHITE))


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def make(year, month=None, day=None) -> Column:
    """A partial date, or null unless it is a calendar date from year 1 on; a null day or month is none."""
    null = F.lit(None).cast("int")
    parts = F.struct(*[(null if c is None else _col(c).cast("int")).alias(k) for k, c in (("year", year), ("month", month), ("day", day))])

    def checked(t: Column) -> Column:
        y, m, d = t["year"], t["month"], t["day"]
        return F.when(y.between(1, 9999) & (m.isNull() | m.between(1, 12)) & (d.isNull() | d.between(1, _month_days(y, m))), t)

    return _let(parts, checked)


def parse(c) -> Column:
    """Y-M-D and Y-M with - or /, YYYYMMDD, YYYYMM, YYYY; null where the text is something else or no date."""
    pattern = r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?|(\d{2})(\d{2})?)?$"

    def read(s: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).cast("int")
        return make(part(1), F.coalesce(part(2), part(4)), F.coalesce(part(3), part(5)))

    return _let(strip(c), read)


def granularity(t) -> Column:
    t = _col(t)
    return F.when(t["day"].isNotNull(), "day").when(t["month"].isNotNull(), "month").when(t["year"].isNotNull(), "year")


def granularity_score(c) -> Column:
    """1, 2 or 3 for a text that is a year, month or day; 0 for anything else."""
    t = parse(c)
    return F.when(t["day"].isNotNull(), 3).when(t["month"].isNotNull(), 2).when(t["year"].isNotNull(), 1).otherwise(0)


def to_text(t) -> Column:
    """Zero-padded, at its own granularity."""
    t = _col(t)
    y = F.lpad(t["year"].cast("string"), 4, "0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(t["day"].isNotNull(), F.concat_ws("-", y, two(t["month"]), two(t["day"]))).when(t["month"].isNotNull(), F.concat_ws("-", y, two(t["month"]))).otherwise(y)


def as_date(t) -> Column:
    """The date of a full day, else null."""
    t = _col(t)
    return F.when(t["day"].isNotNull(), F.make_date(t["year"], t["month"], t["day"]))


def _of_date(d: Column) -> Column:
    return F.when(d.isNotNull() & F.year(d).between(1, 9999), F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")))


def add_years(t, n) -> Column:
    """Keeps the granularity; 29 February becomes 28 in other years."""
    t, n = _col(t), F.lit(n) if isinstance(n, int) else _col(n)
    full = _of_date(F.add_months(as_date(t), n * 12))
    return F.when(t["day"].isNotNull(), full).otherwise(make(t["year"] + n, None).withField("month", t["month"]))


def add_months(t, n) -> Column:
    """Null for a bare year; the day is cut to the month's length."""
    t, n = _col(t), F.lit(n) if isinstance(n, int) else _col(n)
    months = t["year"] * 12 + t["month"] - 1 + n
    by_month = make(F.floor(months / 12), F.pmod(months, F.lit(12)) + 1)
    return F.when(t["day"].isNotNull(), _of_date(F.add_months(as_date(t), n))).when(t["month"].isNotNull(), by_month)


def add_days(t, n) -> Column:
    """Null unless it is a full day."""
    return _of_date(F.date_add(as_date(t), F.lit(n) if isinstance(n, int) else _col(n)))


def ordinal(t) -> Column:
    """Days from 0001-01-01, which is 1."""
    return F.datediff(as_date(t), F.lit("0001-01-01").cast("date")) + 1


def from_ordinal(n) -> Column:
    return _of_date(F.date_add(F.lit("0001-01-01").cast("date"), _col(n).cast("int") - 1))


def subtract(a, b) -> Column:
    """Year, month and day differences one by one, without borrowing; a part that either lacks counts 0."""
    a, b = _col(a), _col(b)
    return F.struct(*[F.coalesce(a[k] - b[k], F.lit(0)).alias(k + "s") for k in ("year", "month", "day")])


def order_key(t) -> Column:
    """Compares as partial dates do: a missing part is before any other."""
    t = _col(t)
    return F.when(t.isNotNull(), F.struct(t["year"].alias("year"), F.coalesce(t["month"], F.lit(0)).alias("month"), F.coalesce(t["day"], F.lit(0)).alias("day")))


def formatted(t, pattern: str) -> Column:
    """%Y %y %m %d; %m and %d stay as they are where the part is missing."""
    t = _col(t)
    y = F.lpad(t["year"].cast("string"), 4, "0")
    out = F.replace(F.replace(F.lit(pattern), F.lit("%Y"), y), F.lit("%y"), F.right(y, F.lit(2)))
    for mark, part in (("%m", t["month"]), ("%d", t["day"])):
        out = F.when(part.isNotNull(), F.replace(out, F.lit(mark), F.lpad(part.cast("string"), 2, "0"))).otherwise(out)
    return F.when(t.isNotNull(), out)


def year_prefix(c) -> Column:
    """The first four characters as a number, or null."""
    return F.expr("1").cast("int") * F.substring(_col(c), 1, 4).try_cast("int")


def first_day(t) -> Column:
    return _let(_col(t), lambda x: F.make_date(x["year"], F.coalesce(x["month"], F.lit(1)), F.coalesce(x["day"], F.lit(1))))


def last_day(t) -> Column:
    """The last day that the partial date covers."""
    return _let(_col(t), lambda x: F.when(x["day"].isNotNull(), as_date(x)).otherwise(F.last_day(F.make_date(x["year"], F.coalesce(x["month"], F.lit(12)), F.lit(1)))))


def compatible(a, b) -> Column:
    """Texts that may name one time: both null, equal, or one a coarser form of the other. Null and a value are not; what
    cannot be parsed must be equal."""
    def both(p: Column) -> Column:
        a, b, x, y = p["a"], p["b"], p["x"], p["y"]
        agree = (x["year"] == y["year"]) & F.coalesce(x["month"] == y["month"], F.lit(True)) & F.coalesce(x["day"] == y["day"], F.lit(True))
        none_a, none_b = a.isNull() | (a == ""), b.isNull() | (b == "")
        return F.when(none_a | none_b, none_a & none_b).when(x.isNull() | y.isNull(), a == b).otherwise(agree)

    a, b = _col(a), _col(b)
    return _let(F.struct(a.alias("a"), b.alias("b"), parse(a).alias("x"), parse(b).alias("y")), both)
