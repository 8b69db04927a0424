"""Array expressions over trace samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(n: Column) -> Column:
    """n zero samples."""
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def int_range(start, stop) -> Column:
    """[start, stop) as an array, empty when stop <= start."""
    start = start if isinstance(start, Column) else F.lit(start)
    stop = stop if isinstance(stop, Column) else F.lit(stop)
    filled = F.sequence(start.cast("int"), (stop - 1).cast("int"))
    return F.when(stop > start, filled).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
