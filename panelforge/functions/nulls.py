"""Missing values: a missing number is NULL, never NaN; infinities are values.

Every builder that could make a NaN, or that could divide by zero under ANSI mode, uses these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clean(c: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(c), c)


def fin(c: Column) -> Column:
    """c where it is finite, else NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


def safe_div(x: Column, y: Column) -> Column:
    """x / y, NULL where y is zero or either is missing."""
    return clean(x / F.when(y != 0, y))


def clip(c: Column, low: Column, high: Column) -> Column:
    """c within [low, high], NULL if any of them is missing."""
    return F.when(c.isNotNull() & low.isNotNull() & high.isNotNull(), F.greatest(F.least(c, high), low))


def all_present(*cols: Column) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out
