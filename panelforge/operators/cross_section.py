"""Cross-sectional operators: over all symbols of one timestamp. Missing values are left out of every
statistic and stay missing; infinities are ranked, and poison means and deviations."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelforge.functions.nulls import clean, clip
from panelforge.functions.probit import probit


def _cs(ts: str):
    return Window.partitionBy(ts)


def rank(x: Column, ts: str = "ts") -> Column:
    """Average rank from 1, ascending."""
    w = Window.partitionBy(ts).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2.0)


def normalize(x: Column, use_std: bool = False, limit: float = 0.0, ts: str = "ts") -> Column:
    y = clean(x - F.avg(x).over(_cs(ts)))
    if use_std:
        sd = clean(F.stddev_pop(x).over(_cs(ts)))
        y = F.when(sd > 0, clean(y / F.when(sd > 0, sd))).otherwise(y)
    return clip(y, F.lit(-float(limit)), F.lit(float(limit))) if limit > 0 else y


def quantile(x: Column, driver: str = "gaussian", sigma: float = 1.0, ts: str = "ts") -> Column:
    """The rank's share of valid symbols, kept half a rank from 0 and 1, mapped by the driver's inverse
    distribution: gaussian, cauchy; uniform is x less its mean; any other name gives the share."""
    if driver == "uniform":
        return clean(x - F.avg(x).over(_cs(ts)))
    n = F.count(x).over(_cs(ts))
    half = 0.5 / n
    share = clip(rank(x, ts) / F.when(n > 0, n), half, 1 - half)
    if driver == "gaussian":
        return sigma * probit(share)
    if driver == "cauchy":
        return sigma * F.tan(math.pi * (share - 0.5))
    return share


def scale(x: Column, scale: float = 1.0, longscale: float = 1.0, shortscale: float = 1.0, ts: str = "ts") -> Column:
    """x over the sum of absolute values, times scale. With a leg scale that is not 1, positives and
    negatives are scaled each to theirs and ``scale`` is not used. A zero sum leaves values as they are."""
    if longscale != 1 or shortscale != 1:
        up, down = F.sum(F.when(x > 0, x)).over(_cs(ts)), F.sum(F.when(x < 0, -x)).over(_cs(ts))
        return clean(F.when((x > 0) & (up > 0), x / F.when(up > 0, up) * longscale).when((x < 0) & (down > 0), x / F.when(down > 0, down) * shortscale).otherwise(x))
    total = F.sum(F.abs(x)).over(_cs(ts))
    return clean(F.when(total > 0, x / F.when(total > 0, total) * scale).otherwise(x))


def winsorize(x: Column, std: float = 4.0, ts: str = "ts") -> Column:
    mean, sd = clean(F.avg(x).over(_cs(ts))), clean(F.stddev_pop(x).over(_cs(ts)))
    return clip(x, mean - std * sd, mean + std * sd)


def zscore(x: Column, ts: str = "ts") -> Column:
    return normalize(x, use_std=True, ts=ts)
