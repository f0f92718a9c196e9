"""Column helpers: one policy for nulls, NaN and division.

A missing pixel is NULL. NaN becomes NULL on the way in, and no operator gives
NaN: a quotient by zero and a function outside its domain are NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(name: str) -> Column:
    """The column of just that name, as DOUBLE."""
    return F.col("`" + name.replace("`", "``") + "`").cast("double")


def lit(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def sqrt(c: Column) -> Column:
    """Square root, NULL for negative numbers."""
    return F.when(c >= 0, F.sqrt(c))


def within(c: Column, low: float | None, high: float | None) -> Column:
    """c where it lies in [low, high], else NULL."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= lit(low))
    if high is not None:
        ok = ok & (c <= lit(high))
    return F.when(ok, c)


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c limited to [low, high]; NULL stays NULL (greatest() would skip it)."""
    out = c
    if low is not None:
        out = F.when(out < lit(low), lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > lit(high), lit(high)).otherwise(out)
    return out


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def dot(a: list[Column], b: list[Column]) -> Column:
    return total([x * y for x, y in zip(a, b)])


def all_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def first_smallest(cols: list[Column]) -> Column:
    """1-based place of the first smallest value; NULL if any is."""
    a = F.array(*cols)
    return F.when(all_present(cols), F.array_position(a, F.array_min(a)).cast("int"))


def first_largest(cols: list[Column]) -> Column:
    """1-based place of the first largest value; NULL if any is."""
    a = F.array(*cols)
    return F.when(all_present(cols), F.array_position(a, F.array_max(a)).cast("int"))
