"""Predictive power of a factor f against forward returns r, and portfolios built on it.

A cell counts only where both f and r are finite. Per-timestamp metrics return (ts, value); the others one
row. Ties are broken by symbol."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.nulls import fin, safe_div
from panelforge.operators.cross_section import rank
from panelforge.plans.panel import Panel
from panelforge.sources.stages import stage

MIN_OBSERVATIONS, YEAR = 750, 252


def valid_pairs(p: Panel, f: str, r: str) -> DataFrame:
    """(symbol, ts, f, r) of the cells where both are finite."""
    out = p.df.select(F.col(p.symbol).alias("symbol"), F.col(p.ts).alias("ts"), fin(F.col(f)).alias("f"), fin(F.col(r)).alias("r"))
    return out.where("f is not null and r is not null")


def _pearson(x: str, y: str) -> Column:
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic(p: Panel, f: str, r: str) -> DataFrame:
    """Pearson correlation per ts; missing for one asset or a constant side."""
    return valid_pairs(p, f, r).groupBy("ts").agg(F.when(F.count("*") > 1, _pearson("f", "r")).alias("value"))


def rank_ic(p: Panel, f: str, r: str) -> DataFrame:
    """Spearman correlation per ts, ranks taken among the valid pairs."""
    v = valid_pairs(p, f, r)
    v = v.withColumn("fr", rank(F.col("f"))).withColumn("rr", rank(F.col("r")))
    return v.groupBy("ts").agg(F.when(F.count("*") > 1, _pearson("fr", "rr")).alias("value"))


def information_ratio(series: DataFrame) -> DataFrame:
    """Mean over population deviation of a metric series; 0 if it is empty or constant."""
    return series.agg(F.coalesce(safe_div(F.avg("value"), F.stddev_pop("value")), F.lit(0.0)).alias("value"))


def mean(series: DataFrame) -> DataFrame:
    return series.agg(F.avg("value").alias("value"))


def turnover_series(p: Panel, f: str) -> DataFrame:
    """Per ts, the change of f since the ts before over its size then, for assets finite at both."""
    w = Window.partitionBy(p.symbol).orderBy(p.ts)
    now = fin(F.col(f))
    v = p.df.select(F.col(p.ts).alias("ts"), now.alias("x"), F.lag(now).over(w).alias("y")).where("x is not null and y is not null")
    size = F.sum(F.abs("y"))
    return v.groupBy("ts").agg(F.when(size > 0, F.sum(F.abs(F.col("x") - F.col("y"))) / F.when(size > 0, size)).otherwise(0.0).alias("value"))


def turnover(p: Panel, f: str) -> DataFrame:
    return mean(turnover_series(p, f))


def _placed(v: DataFrame) -> DataFrame:
    """Each cell's place by factor within its ts, and the ts's number of cells."""
    return v.withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy("f", "symbol"))).withColumn("n", F.count("*").over(Window.partitionBy("ts")))


def top_k_series(p: Panel, f: str, r: str, k: float = 0.1) -> DataFrame:
    """Per ts of 10 assets or more: how far the mean return of the top or of the bottom k is above all."""
    v = _placed(valid_pairs(p, f, r)).where("n >= 10").withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * k)))
    top, low = F.avg(F.when(F.col("place") > F.col("n") - F.col("k"), F.col("r"))), F.avg(F.when(F.col("place") <= F.col("k"), F.col("r")))
    return v.groupBy("ts").agg((F.greatest(top, low) - F.avg("r")).alias("value"))


def top_k_returns(p: Panel, f: str, r: str, k: float = 0.1) -> DataFrame:
    return mean(top_k_series(p, f, r, k))


def monotonicity_series(p: Panel, f: str, r: str, groups: int = 10) -> DataFrame:
    """Per ts of at least ``groups`` assets: the larger of how often the groups' mean return rises and
    falls from group to group, over the number of groups."""
    v = valid_pairs(p, f, r).withColumn("n", F.count("*").over(Window.partitionBy("ts"))).where(F.col("n") >= groups)
    v = v.withColumn("g", F.ntile(groups).over(Window.partitionBy("ts").orderBy("f", "symbol")))
    step = v.groupBy("ts", "g").agg(F.avg("r").alias("m"))
    step = step.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy("ts").orderBy("g")))
    up, down = F.sum(F.when(F.col("d") > 0, 1).otherwise(0)), F.sum(F.when(F.col("d") < 0, 1).otherwise(0))
    return step.groupBy("ts").agg((F.greatest(up, down) / float(groups)).alias("value"))


def monotonicity(p: Panel, f: str, r: str, groups: int = 10) -> DataFrame:
    return mean(monotonicity_series(p, f, r, groups))


def high_minus_low(p: Panel, f: str, r: str, share: float = 0.5) -> DataFrame:
    """(ts, value): mean log return of the top share of assets less that of the bottom, for ts of 10 assets
    or more. If any ts of more than 10 has under five different factor values, the series is empty."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    v = _placed(valid_pairs(p, f, r)).where("n >= 10").withColumn("k", F.floor(F.col("n") * share))
    gain = F.when(F.col("r") > -1, F.log1p("r"))
    top, low = F.avg(F.when(F.col("place") > F.col("n") - F.col("k"), gain)), F.avg(F.when(F.col("place") <= F.col("k"), gain))
    out = v.groupBy("ts").agg((top - low).alias("value"), ((F.max("n") > 10) & (F.count_distinct("f") < 5)).alias("flat"))
    # one row of all timestamps, which the time axis bounds: the series is made once
    rows = out.agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ts", "value"))).alias("rows"), F.coalesce(F.max("flat"), F.lit(False)).alias("flat"))
    return rows.where("not flat").select(F.inline("rows"))


def sharpe(p: Panel, f: str, r: str, rf: float = 0.01, share: float = 0.1) -> DataFrame:
    v = high_minus_low(p, f, r, share)
    sd = F.stddev_samp("value") * math.sqrt(YEAR)
    return v.agg(F.when(F.count("*") >= MIN_OBSERVATIONS, safe_div(F.avg("value") * math.sqrt(YEAR) - math.log(1 + rf), sd)).alias("value"))


def calmar(p: Panel, f: str, r: str, share: float = 0.1) -> DataFrame:
    """Over one row per ts, a series the time axis bounds; its peak starts at the first cumulated value."""
    v = high_minus_low(p, f, r, share)
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = v.withColumn("total", F.sum("value").over(w))
    v = v.withColumn("down", F.col("total") - F.max("total").over(w))
    return v.agg(F.when(F.count("*") >= MIN_OBSERVATIONS, safe_div(F.avg("value") * math.sqrt(YEAR), F.abs(F.min("down")))).alias("value"))


def sortino(p: Panel, f: str, r: str, rf: float = 0.01, share: float = 0.1) -> DataFrame:
    v = high_minus_low(p, f, r, share)
    floor = math.log(1 + rf)
    down = F.stddev_samp(F.when(F.col("value") < floor, F.col("value"))) * math.sqrt(YEAR)
    return v.agg(F.when(F.count("*") >= MIN_OBSERVATIONS, safe_div(F.avg("value") * math.sqrt(YEAR) - floor, down)).alias("value"))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_p_value(rho: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs under no correlation."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return _beta_share(df / 2, 0.5, df / (df + t2))


def _ranked(v: DataFrame, x: str, out: str) -> DataFrame:
    """v with the average rank of x among all rows: counts per value, summed up over ranges of values that are
    staged, and joined back. No task has more than a range of the values."""
    counts = stage(v.groupBy(x).agg(F.count("*").alias("n")).repartitionByRange(x).withColumn("part", F.spark_partition_id()), "values")
    before = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn("upto", upto).join(F.broadcast(before), "part").select(x, (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2.0).alias(out))
    return v.join(ranks, x)


def spearman_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the Spearman correlation of two columns, 0 unless its p is under 0.05, missing without
    pairs."""
    v = df.select((fin(F.col(x)) + 0.0).alias("f"), (fin(F.col(y)) + 0.0).alias("r")).where("f is not null and r is not null")  # -0.0 is 0.0
    v = _ranked(_ranked(v, "f", "fr"), "r", "rr")
    one = v.agg(_pearson("fr", "rr").alias("rho"), F.count("*").alias("n"))

    def significant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if not n else rho if rho is not None and t_p_value(rho, n) < 0.05 else 0.0 for rho, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64())], names=["value"])

    return one.mapInArrow(significant, "value double")


def weighted_fitness(p: Panel, f: str, r: str, weights: dict[str, float] | None = None, k: float = 0.1, groups: int = 10) -> DataFrame:
    """One row: the weighted sum of mean rank IC ("rankic"), top-k return ("top_r") and monotonicity
    ("mono"); -1 if it is missing. All of them come from one grouped aggregation of ranked pairs."""
    weights = weights or {"rankic": 1.0}
    v = valid_pairs(p, f, r)
    aggs: dict[str, Column] = {}
    if "rankic" in weights:
        v = v.withColumn("fr", rank(F.col("f"))).withColumn("rr", rank(F.col("r")))
        aggs["rankic"] = F.when(F.count("*") > 1, _pearson("fr", "rr"))
    if {"top_r", "mono"} & weights.keys():
        v = _placed(v)
    if "top_r" in weights:
        many = F.greatest(F.lit(1), F.floor(F.col("n") * k))
        top, low = F.avg(F.when(F.col("place") > F.col("n") - many, F.col("r"))), F.avg(F.when(F.col("place") <= many, F.col("r")))
        aggs["top_r"] = F.when(F.max("n") >= 10, F.greatest(top, low) - F.avg("r"))
    if "mono" in weights:
        v = v.withColumn("g", F.ntile(groups).over(Window.partitionBy("ts").orderBy("f", "symbol")))
        means = [F.avg(F.when(F.col("g") == g, F.col("r"))) for g in range(1, groups + 1)]
        aggs |= {f"mean{g}": m for g, m in enumerate(means)} | {"assets": F.max("n")}
    daily = v.groupBy("ts").agg(*[c.alias(n) for n, c in aggs.items()])
    if "mono" in weights:
        steps = [(F.col(f"mean{g + 1}"), F.col(f"mean{g}")) for g in range(groups - 1)]
        up, down = (sum((F.when(a > b if rising else a < b, 1).otherwise(0) for a, b in steps), F.lit(0)) for rising in (True, False))
        daily = daily.withColumn("mono", F.when(F.col("assets") >= groups, F.greatest(up, down) / float(groups)))
    total = sum((F.avg(name) * w for name, w in weights.items()), F.lit(0.0))
    return daily.agg(F.coalesce(total, F.lit(-1.0)).alias("value"))


def correlation_fitness(p: Panel, f: str, r: str) -> DataFrame:
    """One row: mean Spearman correlation per ts, infinities ranked; minus infinity if it is missing."""
    v = p.df.select(F.col(p.ts).alias("ts"), F.col(f).alias("f"), F.col(r).alias("r")).where("f is not null and r is not null")
    v = v.withColumn("fr", rank(F.col("f"))).withColumn("rr", rank(F.col("r")))
    one = v.groupBy("ts").agg(F.when(F.count("*") > 1, _pearson("fr", "rr")).alias("value"))
    return one.agg(F.coalesce(F.avg("value"), F.lit(float("-inf"))).alias("value"))
