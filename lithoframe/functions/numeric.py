"""Scalar rules: rounding, floor division, guarded ratios, percentile labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Round to the nearest integer, halves to even."""
    return F.rint(c).cast("int")


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded towards minus infinity."""
    return F.floor(a / b).cast("int")


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, c))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or the default where den is zero or null."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(default))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def mean_of(flag: Column) -> Column:
    """Share of rows for which the flag holds."""
    return F.avg(flag.cast("int"))


# The number spellings a pick file may use.
_NUMBER = r"(?i)^[+-]?((\d[\d_]*)?\.?\d[\d_]*\.?([eE][+-]?\d+)?|\d[\d_]*\.([eE][+-]?\d+)?|inf|infinity|nan)$"


def parse_number(text: Column) -> Column:
    """A double, or null for text that is not a plain decimal number.

    A bare cast would also take suffixes such as 1d or 2f. Digit-separating underscores are allowed.
    """
    plain = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    return F.when(text.rlike(_NUMBER), plain.try_cast("double"))
