"""Vector columns: arrays of numbers, computed in double precision inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, z: s + z)


def dot(a, b) -> Column:
    return _total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a) -> Column:
    return F.sqrt(_total(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a, b) -> Column:
    return _total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def normalize(a) -> Column:
    """a at unit length; a zero vector stays zero."""
    # the norm is bound by an outer lambda: within the inner one it would be computed for each element
    by = lambda n: F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.transform(F.array(l2_norm(a)), by)[0]


def bucket(x: Column, cutoffs: list[float]) -> Column:
    """How many of the sorted cutoffs are at most x."""
    out = F.lit(0)
    for c in cutoffs:
        out = out + (F.lit(float(c)) <= x).cast("int")
    return out


def max_sim(query: list[list[float]], tokens) -> Column:
    """Sum over query tokens of the best inner product with a document token, floored at 0."""

    def best(q: list[float]) -> Column:
        q_col = F.array(*[F.lit(float(v)) for v in q])
        return F.greatest(F.coalesce(F.array_max(F.transform(_c(tokens), lambda t: dot(t, q_col))), F.lit(0.0)), F.lit(0.0))

    return sum((best(q) for q in query), F.lit(0.0))
