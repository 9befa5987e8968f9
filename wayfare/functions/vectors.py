"""Vector expressions over ``array<float>`` columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def length(v) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when used inside array lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v) -> Column:
    """The vector divided by its length; a zero vector becomes null."""

    def divide(d: Column) -> Column:
        return let(
            F.nullif(length(d), F.lit(0.0)),
            lambda size: F.when(size.isNotNull(), F.transform(d, lambda x: x / size)),
        )

    return let(_doubles(v), divide)


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0))
