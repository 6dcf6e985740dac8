"""Operators against independent numpy, on a hostile panel: gaps, infinities, zeros, ties, constants."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.plans.expr import evaluate
from panelforge.plans.panel import Panel

S, T = 6, 24


def hostile(seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (S, T)), 1)
    y = np.round(rng.normal(5, 2, (S, T)), 1)
    x[rng.random((S, T)) < 0.15] = np.nan
    x[rng.random((S, T)) < 0.1] = 0
    x[1] = 1.23
    x[2, :10] = np.nan
    x[3, 12:] = x[3, 11] if not np.isnan(x[3, 11]) else 2.0
    x[4, 5], x[5, 7] = np.inf, -np.inf
    y[:, 10] = -0.5
    return x, y


@pytest.fixture(scope="module")
def panel(spark):
    x, y = hostile()
    rows = [(f"s{s}", t, None if np.isnan(x[s, t]) else float(x[s, t]), float(y[s, t])) for s in range(S) for t in range(T)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double, y double").cache()
    return Panel(df, ("x", "y"))


def matrix(panel, expression):
    out = np.full((S, T), np.nan)
    for r in evaluate(panel, {"v": expression}).df.select("symbol", "ts", "v").where(F.col("ts") < T).collect():
        out[int(r["symbol"][1:]), r["ts"]] = np.nan if r["v"] is None else r["v"]
    return out


def avg_rank(v):
    return np.array([np.nan if np.isnan(a) else ((v < a).sum() + 1 + (v <= a).sum()) / 2 for a in v])


def by_time(f):
    def run(x, y):
        with np.errstate(all="ignore"):
            return np.stack([f(x[:, t]) for t in range(T)], axis=1)

    return run


def rolling(f, d, finite=True):
    def run(x, y):
        out = np.full((S, T), np.nan)
        for s in range(S):
            for t in range(d - 1, T):
                w, v = x[s, t - d + 1 : t + 1], y[s, t - d + 1 : t + 1]
                if not finite or np.isfinite(w).all():
                    out[s, t] = f(w, v)
        return out

    return run


def normalized(v):
    return v - np.nanmean(v)


def zscored(v):
    sd = np.nanstd(v)
    return normalized(v) / sd if sd > 0 else normalized(v)


def winsorized(v):
    m, sd = np.nanmean(v), np.nanstd(v)
    return np.clip(v, m - 4 * sd, m + 4 * sd) if np.isfinite(sd) else np.full(len(v), np.nan)


def scaled(v):
    with np.errstate(invalid="ignore"):
        n = np.nansum(np.abs(v))
        return v / n if n > 0 else v


def gaussian(v):
    r, n = avg_rank(v), (~np.isnan(v)).sum()
    return np.array([np.nan if np.isnan(a) else NormalDist().inv_cdf(min(max(a / n, 0.5 / n), 1 - 0.5 / n)) for a in r])


def last_change(x, y):
    out = np.zeros((S, T))
    for s in range(S):
        k = 0
        for t in range(T):
            k = 0 if t == 0 or not x[s, t] == x[s, t - 1] else k + 1
            out[s, t] = k
    return out


def humped(x, y):
    out = x.copy()
    for s in range(S):
        for t in range(1, T):
            d = x[s, t] - out[s, t - 1]
            out[s, t] = out[s, t - 1] + np.clip(d, -0.5, 0.5)
    return out


def kth(x, y):
    out = np.full((S, T), np.nan)
    for s in range(S):
        for t in range(T):
            w = x[s, max(0, t - 4) : t + 1]
            w = w[~np.isnan(w)]
            if len(w):
                out[s, t] = w[min(2, len(w)) - 1]
    return out


def last_diff(x, y):
    out = np.full((S, T), np.nan)
    for s in range(S):
        for t in range(T):
            for v in x[s, max(0, t - 4) : t][::-1]:
                c = x[s, t]
                if np.isnan(v) != np.isnan(c) or (not np.isnan(v) and abs(v - c) > 1e-9):
                    out[s, t] = v
                    break
    return out


def positions(f):
    def g(w, v):
        gap = np.flatnonzero(np.isnan(w))
        return (gap[0] if len(gap) else f(w)) + 1

    return g


def std1(w):
    return np.std(w, ddof=1)


def div(a, b):
    with np.errstate(all="ignore"):
        return np.where(b == 0, 1e6, a / b)


def ratio(w):
    return (w[-1] - w.mean()) / std1(w) if w.max() > w.min() else np.nan


def quantile_last(w, v):
    n = len(w)
    return NormalDist().inv_cdf(min(max(avg_rank(w)[-1] / n, 0.5 / n), 1 - 0.5 / n))


CASES = {
    "add(x, y)": lambda x, y: x + y,
    "subtract(x, y)": lambda x, y: x - y,
    "multiply(x, y)": lambda x, y: x * y,
    "divide(y, x)": lambda x, y: div(y, x),
    "inverse(x)": lambda x, y: div(np.ones_like(x), x),
    "abs(x)": lambda x, y: np.abs(x),
    "sqrt(x)": lambda x, y: np.sqrt(x),
    "reverse(x)": lambda x, y: -x,
    "maximum(x, y)": np.maximum,
    "minimum(x, y)": np.minimum,
    "s_log_1p(x)": lambda x, y: 2 / (1 + np.exp(-np.log1p(np.abs(x)))) - 1,
    "log(x)": lambda x, y: np.log(x),
    "sign(x)": lambda x, y: np.sign(x),
    "signed_power(x, 3.0)": lambda x, y: np.sign(x) * np.abs(x) ** 3,
    "power(x, 2)": lambda x, y: x**2,
    "rank(x)": by_time(avg_rank),
    "normalize(x)": by_time(normalized),
    "zscore(x)": by_time(zscored),
    "winsorize(x)": by_time(winsorized),
    "scale(x)": by_time(scaled),
    "quantile(x)": by_time(gaussian),
    "ts_delay(x, 3)": lambda x, y: np.hstack([np.full((S, 3), np.nan), x[:, :-3]]),
    "ts_delta(x, 3)": lambda x, y: x - np.hstack([np.full((S, 3), np.nan), x[:, :-3]]),
    "ts_sum(x, 4)": rolling(lambda w, v: w.sum(), 4),
    "ts_mean(x, 4)": rolling(lambda w, v: w.mean(), 4),
    "ts_min(x, 4)": rolling(lambda w, v: w.min(), 4),
    "ts_max(x, 4)": rolling(lambda w, v: w.max(), 4),
    "ts_std_dev(x, 4)": rolling(lambda w, v: std1(w), 4),
    "ts_zscore(x, 4)": rolling(lambda w, v: ratio(w), 4),
    "ts_cov(x, y, 4)": rolling(lambda w, v: np.cov(w, v)[0, 1], 4),
    "ts_corr(x, y, 4)": rolling(lambda w, v: np.corrcoef(w, v)[0, 1] if w.max() > w.min() and v.max() > v.min() else np.nan, 4),
    "ts_arg_min(x, 4)": rolling(positions(np.argmin), 4, False),
    "ts_arg_max(x, 4)": rolling(positions(np.argmax), 4, False),
    "ts_rank(x, 4)": rolling(lambda w, v: np.argsort(np.argsort(w, kind="stable"), kind="stable")[-1] + 1, 4, False),
    "ts_product(x, 4)": rolling(lambda w, v: w.prod(), 4),
    "ts_decay_linear(x, 4)": rolling(lambda w, v: (w * [1, 2, 3, 4]).sum() / 10, 4),
    "ts_scale(x, 4)": rolling(lambda w, v: (w[-1] - w.min()) / (w.max() - w.min()) if w.max() > w.min() else np.nan, 4),
    "ts_regression(y, x, 4)": rolling(lambda w, v: np.cov(v, w, ddof=0)[0, 1] / np.var(w) if w.max() > w.min() else np.nan, 4),
    "ts_quantile(x, 4)": rolling(quantile_last, 4),
    "days_from_last_change(x)": last_change,
    "hump(x, 0.5)": humped,
    "kth_element(x, 5, 2)": kth,
    "last_diff_value(x, 4)": last_diff,
    "ts_mean(rank(ts_sum(y, 3)), 4)": None,
    "ts_sum(x, 99)": lambda x, y: np.full((S, T), np.nan),
    "ts_rank(x, 99)": lambda x, y: np.full((S, T), np.nan),
}


@pytest.mark.parametrize("expression", CASES)
def test_against_numpy(panel, expression):
    got = matrix(panel, expression)
    if CASES[expression] is None:
        assert np.isfinite(got[:, 5:]).all() and np.isnan(got[:, :5]).all()
        return
    x, y = hostile()
    with np.errstate(all="ignore"):
        want = CASES[expression](x, y)
    if expression.startswith(("ts_cov", "ts_corr")):
        want = np.round(want, 5)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1.1e-5 if "_co" in expression else 1e-9, equal_nan=True)


def test_no_look_ahead(panel, spark):
    """Rows added later change nothing before them."""
    more = spark.createDataFrame([(f"s{s}", T + k, 9.0 + s + k, 1.0) for s in range(S) for k in range(3)], "symbol string, ts int, x double, y double")
    longer = Panel(panel.df.union(more), panel.fields)
    for e in [c for c in CASES if c.startswith(("ts_", "kth", "last_", "days", "hump"))][::3]:
        np.testing.assert_array_equal(matrix(panel, e), matrix(longer, e))


def test_properties(panel):
    r, z, s = (matrix(panel, e) for e in ("rank(y)", "zscore(y)", "scale(y)"))
    assert np.allclose(r.sum(axis=0), S * (S + 1) / 2)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.abs(s).sum(axis=0), 1)


def test_probit(spark):
    from panelforge.functions.probit import probit

    ps = [1e-300, 1e-20, 1e-12, 1e-6, 0.02, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0]], "p double").select(probit(F.col("p"))).collect()]
    assert got[len(ps) :] == [None] * 3
    for p, z in zip(ps, got, strict=False):
        assert math.isclose(z, NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-12)


def test_scale_legs_and_quantile_drivers(panel):
    from panelforge.operators import cross_section as cs

    rows = panel.df.select("ts", cs.scale(cs.normalize(F.col("y")), 7, 2, 3).alias("a"), cs.quantile(F.col("y"), "cauchy").alias("b"), cs.quantile(F.col("y"), "other").alias("c"), cs.quantile(F.col("y"), "uniform").alias("d")).where("ts = 3").collect()
    assert math.isclose(sum(r["a"] for r in rows if r["a"] > 0), 2) and math.isclose(sum(r["a"] for r in rows if r["a"] < 0), -3)
    for r in rows:
        assert math.isclose(r["b"], math.tan(math.pi * (r["c"] - 0.5)))
    assert math.isclose(sum(r["d"] for r in rows), 0, abs_tol=1e-9)


def test_quantile_of_many_symbols(spark):
    """The far ends of large cross-sections, against the standard library."""
    from panelforge.operators import cross_section as cs

    n = 3000
    df = spark.range(n).select(F.lit(0).alias("ts"), (F.col("id") * 7 % n).cast("double").alias("x"))
    got = {r["x"]: r["q"] for r in df.select("x", cs.quantile(F.col("x")).alias("q")).collect()}
    want = {float(k): NormalDist().inv_cdf(min(max((k + 1) / n, 0.5 / n), 1 - 0.5 / n)) for k in range(n)}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
