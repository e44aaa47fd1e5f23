"""Arithmetic on array<float> vectors, in double precision and inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def l2_score(a, b) -> Column:
    return 1 / (1 + l2(a, b))


def normalised(a) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(_col(a), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


METRICS = {"cosine": cosine, "ip": dot, "l2": l2_score}
