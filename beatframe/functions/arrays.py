"""Vector functions on array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def sum_of(a, f) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + f(x))


def sum_of_two(a, b, f) -> Column:
    return total(F.zip_with(col(a), col(b), f))


def dot(a, b) -> Column:
    return sum_of_two(a, b, lambda x, y: x * y)


def sum_squares(a) -> Column:
    return sum_of(a, lambda x: x * x)


def norm(a) -> Column:
    return F.sqrt(sum_squares(a))


def rms(a) -> Column:
    """Null for an empty array."""
    return F.sqrt(F.try_divide(sum_squares(a), F.size(col(a))))


def plus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def scaled(a, factor) -> Column:
    return F.transform(col(a), lambda x: x * factor)


def argmax(a) -> Column:
    """First index of the largest value, from 0."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def argmin(a) -> Column:
    return (F.array_position(col(a), F.array_min(col(a))) - 1).cast("int")


def finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(a) -> Column:
    return F.forall(col(a), finite)


def close(x, y, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(x - y) <= F.lit(atol) + rtol * F.abs(y)


def let(value: Column, f) -> Column:
    """f of a value that is computed once for each row, however often f uses it: a column put into a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quantile(a, q: float) -> Column:
    """Linearly interpolated quantile of one array; null when it is empty. Nulls stand last."""
    at = F.lit(q) * (F.size(col(a)) - 1)
    lo = F.floor(at).cast("int")

    def between(s):
        low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(col(a)) - 1))
        return low + (high - low) * (at - lo)

    return let(F.sort_array(F.array_compact(col(a))), between)


def long(df, vector: str, *, index: str = "i", value: str = "x"):
    """One row for each component: index from 0, value."""
    keep = [c for c in df.columns if c != vector]
    return df.select(*keep, F.posexplode(vector).alias(index, value))


def wide(df, keys: list[str], *, index: str = "i", value: str = "x", vector: str = "v"):
    """The arrays again, by index."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["x"]).alias(vector))
