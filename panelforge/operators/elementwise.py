"""Elementwise operators: Columns in, a Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.nulls import INF, all_present, clean

#: What division by zero gives, and gave in the legacy operators.
ZERO_DIVISION, LEGACY_ZERO_DIVISION = 1e6, 1e16


def add(x: Column, y: Column) -> Column:
    return clean(x + y)


def subtract(x: Column, y: Column) -> Column:
    return clean(x - y)


def multiply(x: Column, y: Column) -> Column:
    return clean(x * y)


def divide(x: Column, y: Column, sentinel: float = ZERO_DIVISION) -> Column:
    """x / y; the sentinel wherever y is zero, even for a missing x."""
    return F.when(y == 0, F.lit(sentinel)).otherwise(clean(x / F.when(y != 0, y)))


def inverse(x: Column) -> Column:
    return divide(F.lit(1.0), x)


def absolute(x: Column) -> Column:
    return F.abs(x)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def reverse(x: Column) -> Column:
    return -x


def maximum(*xs: Column) -> Column:
    """Missing if any argument is."""
    return F.when(all_present(*xs), F.greatest(*xs))


def minimum(*xs: Column) -> Column:
    """Missing if any argument is."""
    return F.when(all_present(*xs), F.least(*xs))


def s_log_1p(x: Column) -> Column:
    """2 sigmoid(log(1 + |x|)) - 1; 1 for an infinity."""
    return 2 / (1 + F.exp(-F.log1p(F.abs(x)))) - 1


def log(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0, missing below."""
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def sign(x: Column) -> Column:
    return F.signum(x)


def signed_power(x: Column, a: float) -> Column:
    return clean(F.signum(x) * F.pow(F.abs(x), F.lit(float(a))))


def power(x: Column, a: float) -> Column:
    return clean(F.pow(x, F.lit(float(a))))
