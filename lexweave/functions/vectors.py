"""Vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: str | Column) -> Column:
    return _col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it (also within lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(v: str | Column) -> Column:
    """The vector in double precision, of length 1; a zero vector is an error."""

    def scaled(d: Column, n: Column) -> Column:
        return F.when(n == 0, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(F.transform(d, lambda x: x / n))

    return bind(doubles(v), lambda d: bind(norm(d), lambda n: scaled(d, n)))


def blend(a: str | Column, b: str | Column, weight: float) -> Column:
    """Unit vector of weight * unit(a) + (1 - weight) * unit(b)."""
    return unit(F.zip_with(unit(a), unit(b), lambda x, y: x * weight + y * (1 - weight)))


def is_valid(v: str | Column, dimensions: int) -> Column:
    """Of the given length, finite and not zero."""
    c = doubles(v)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(c) == dimensions) & finite & F.exists(c, lambda x: x != 0), F.lit(False))
