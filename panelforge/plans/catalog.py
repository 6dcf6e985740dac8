"""The named queries over the driver's tables, each with the SQL that gives the same rows.

Panels come from the tables as bars: A suppliers by month, B suppliers by week (with gaps), C brands by
three days (a long axis), D users by day. Results are (symbol, ts, v), (ts, v) or one row; doubles are
rounded to six places; what is missing is NULL."""

from __future__ import annotations

import io
import math
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans import gp
from panelforge.plans import metrics as M
from panelforge.plans.expr import dialect, evaluate, legacy, native, parse
from panelforge.plans.panel import Panel, bars
from panelforge.sources import ingest, klines, quality, timeparse
from panelforge.sources.stages import shared_folder, stage
from panelforge.streaming import updates

PLACES = 1e6


def rounded(c: Column) -> Column:
    """Six places, half to even, by the same two operations in both engines."""
    return F.rint(c.cast("double") * PLACES) / PLACES


def rounded_sql(sql: str) -> str:
    return f"round_even(CAST({sql} AS DOUBLE) * 1e6, 0) / 1e6"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _lineitem_bars(df: DataFrame, symbol: Column, ts: Column) -> Panel:
    return bars(df, symbol, ts, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice"), list(_ORDER))


def panel_a(spark: SparkSession, sf_dir: str) -> Panel:
    return _lineitem_bars(_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.trunc(F.col("l_shipdate").cast("date"), "month"))


def panel_b(spark: SparkSession, sf_dir: str) -> Panel:
    return _lineitem_bars(_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.trunc(F.col("l_shipdate").cast("date"), "week"))


def panel_c(spark: SparkSession, sf_dir: str) -> Panel:
    df = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    origin = F.lit("1995-01-01").cast("date")
    days = F.floor(F.datediff(F.col("l_shipdate").cast("date"), origin) / 3).cast("int") * 3
    return _lineitem_bars(df, F.col("p_brand"), F.date_add(origin, days))


def panel_d(spark: SparkSession, sf_dir: str) -> Panel:
    df = _table(spark, sf_dir, "events")
    return bars(df, F.col("user_id"), F.col("ts").cast("date"), F.col("value"), F.col("value"), F.col("value"), ["ts", "event_id"])


PANELS = {"a": panel_a, "b": panel_b, "c": panel_c, "d": panel_d}


def _bars_sql(symbol: str, ts: str, frm: str = "lineitem", price: str = "l_extendedprice / l_quantity", volume: str = "l_quantity", amount: str = "l_extendedprice", order: str = ", ".join(_ORDER)) -> str:
    return f"""bars AS (SELECT {symbol} AS symbol, {ts} AS ts, first({price} ORDER BY {order}) AS open, max({price}) AS high, min({price}) AS low,
  last({price} ORDER BY {order}) AS close, sum({volume}) AS volume, sum({amount}) AS quote_volume, count(*)::DOUBLE AS trades FROM {frm} GROUP BY 1, 2)"""


BARS_SQL = {
    "a": _bars_sql("l_suppkey", "date_trunc('month', l_shipdate)::DATE"),
    "b": _bars_sql("l_suppkey", "date_trunc('week', l_shipdate)::DATE"),
    "c": _bars_sql("p_brand", "DATE '1995-01-01' + CAST(floor(datediff('day', DATE '1995-01-01', l_shipdate::DATE) / 3.0) AS INTEGER) * 3", "lineitem JOIN part ON l_partkey = p_partkey"),
    "d": _bars_sql("user_id", "ts::DATE", "events", "value", "value", "value", "events.ts, event_id"),
}
DENSE_SQL = """panel AS (SELECT g.symbol, g.ts, b.open, b.high, b.low, b.close, b.volume, b.quote_volume, b.trades
  FROM (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM bars) s, (SELECT DISTINCT ts FROM bars) t) g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts)"""
TSW = "(PARTITION BY symbol ORDER BY ts)"
RETURNS_SQL = f"""moved AS (SELECT *, lead(open, 1) OVER {TSW} AS o1, lead(open, 2) OVER {TSW} AS o2 FROM panel),
full_ret AS (SELECT * EXCLUDE (o1, o2), CASE WHEN o1 <> 0 THEN (o2 - o1) / o1 END AS fwd_ret FROM moved),
ret AS (SELECT * FROM full_ret WHERE ts NOT IN (SELECT DISTINCT ts FROM panel ORDER BY ts DESC LIMIT 2))"""


def _with(panel: str, *more: str) -> str:
    return "WITH " + ",\n".join([BARS_SQL[panel], DENSE_SQL, *more]) + "\n"


def _expression(name: str, expression: str, sql: str, panel: str = "a", steps: tuple[str, ...] = (), frm: str = "panel") -> None:
    """A query of one expression over a dense panel; sql is its value over ``frm``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = evaluate(PANELS[panel](spark, sf_dir).densify(), {"value": expression})
        return p.df.select("symbol", "ts", rounded(F.col("value")).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _with(panel, *steps) + f"SELECT symbol, ts, {rounded_sql(sql)} AS v FROM {frm}"


# Elementwise.
_expression("e_add", "add(open, close)", "open + close")
_expression("e_subtract", "subtract(close, open)", "close - open")
_expression("e_multiply", "multiply(close, volume)", "close * volume")
_expression("e_divide", "divide(volume, subtract(close, open))", "CASE WHEN close - open = 0 THEN 1e6 ELSE volume / (close - open) END")
_expression("e_inverse", "inverse(subtract(high, low))", "CASE WHEN high - low = 0 THEN 1e6 ELSE 1 / (high - low) END")
_expression("e_abs", "abs(subtract(close, open))", "abs(close - open)")
_expression("e_sqrt", "sqrt(subtract(close, open))", "CASE WHEN close - open >= 0 THEN sqrt(close - open) END")
_expression("e_reverse", "reverse(close)", "-close")
_expression("e_maximum", "maximum(open, close)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END")
_expression("e_minimum", "minimum(open, close)", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END")
_expression("e_s_log_1p", "s_log_1p(subtract(close, open))", "2 / (1 + exp(-ln(1 + abs(close - open)))) - 1")
_expression("e_log", "log(subtract(close, open))", "CASE WHEN close - open = 0 THEN '-inf'::DOUBLE WHEN close - open > 0 THEN ln(close - open) END")
_expression("e_sign", "sign(subtract(close, open))", "sign(close - open)")
_expression("e_signed_power", "signed_power(subtract(close, open), 2.0)", "sign(close - open) * pow(abs(close - open), 2)")
_expression("e_power", "power(trades, 2)", "pow(trades, 2)")



def _registered(name: str, registry: Callable, expression: str, sql: str) -> None:
    """A query of an expression of another registry than the native one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(panel_a(spark, sf_dir).densify(), {"value": expression}, registry()).df.select("symbol", "ts", rounded(F.col("value")).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _with("a") + f"SELECT symbol, ts, {rounded_sql(sql)} AS v FROM panel"


_registered("dialect_add_nf", dialect, "add_nf(close, 2.5)", "close + 2.5")
_registered("dialect_subtract_fn", dialect, "subtract_fn(100.0, close)", "100 - close")
_registered("dialect_multiply_ff", dialect, "multiply_nf(close, multiply_ff(3.0, 0.5))", "close * 1.5")
_registered("dialect_divide_fn", dialect, "divide_fn(2.0, subtract(close, open))", "CASE WHEN close - open = 0 THEN 1e6 ELSE 2 / (close - open) END")
_registered("dialect_divide_nf", dialect, "divide_nf(close, 4.0)", "close / 4")
_registered("dialect_max_nf", dialect, "max_nf(subtract(close, open), 0.0)", "CASE WHEN close - open IS NOT NULL THEN greatest(close - open, 0) END")
_registered("dialect_min_fn", dialect, "min_fn(0.0, subtract(close, open))", "CASE WHEN close - open IS NOT NULL THEN least(close - open, 0) END")
_registered("dialect_inverse_f", dialect, "multiply_fn(inverse_f(8.0), add_fn(reverse_f(1.0), close))", "0.125 * (close - 1)")
_registered("dialect_signed_power", dialect, "signed_power(subtract(close, open), 2)", "sign(close - open) * pow(abs(close - open), 2)")
_registered("legacy_divide", legacy, "divide(volume, subtract(close, open))", "CASE WHEN close - open = 0 THEN 1e16 ELSE volume / (close - open) END")
_registered("legacy_names", legacy, "delta(fabs(subtract(close, delay(close, 1))), 2)", "close")
ORACLE["legacy_names"] = _with("a", f"steps AS (SELECT *, abs(close - lag(close, 1) OVER {TSW}) AS y FROM panel)") + f"SELECT symbol, ts, {rounded_sql(f'y - lag(y, 2) OVER {TSW}')} AS v FROM steps"

# Cross-section.
_CS = "OVER (PARTITION BY ts)"
_RANK = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {x} ASC NULLS LAST) + count({x}) OVER (PARTITION BY ts ORDER BY {x} ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 END"
_expression("cs_rank", "rank(close)", _RANK.format(x="close"))
_expression("cs_rank_ties", "rank(trades)", _RANK.format(x="trades"))
_expression("cs_normalize", "normalize(close)", f"close - avg(close) {_CS}")
_expression("cs_zscore", "zscore(close)", f"CASE WHEN stddev_pop(close) {_CS} > 0 THEN (close - avg(close) {_CS}) / stddev_pop(close) {_CS} ELSE close - avg(close) {_CS} END")
_expression("cs_scale", "scale(normalize(close))", f"CASE WHEN sum(abs(y)) {_CS} > 0 THEN y / sum(abs(y)) {_CS} ELSE y END", steps=(f"centred AS (SELECT *, close - avg(close) {_CS} AS y FROM panel)",), frm="centred")
_expression("cs_winsorize", "winsorize(volume)", f"CASE WHEN volume IS NOT NULL THEN greatest(least(volume, avg(volume) {_CS} + 4 * stddev_pop(volume) {_CS}), avg(volume) {_CS} - 4 * stddev_pop(volume) {_CS}) END")


def _column(name: str, build: Callable[[], Column], sql: str, panel: str = "a", steps: tuple[str, ...] = (), frm: str = "panel") -> None:
    """A query of one builder called with other than its defaults."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return PANELS[panel](spark, sf_dir).densify().df.select("symbol", "ts", rounded(build()).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _with(panel, *steps) + f"SELECT symbol, ts, {rounded_sql(sql)} AS v FROM {frm}"


def _add_cross_section() -> None:
    from panelforge.operators import cross_section as cs

    z = f"(close - avg(close) {_CS}) / stddev_pop(close) {_CS}"
    _column("cs_normalize_std", lambda: cs.normalize(F.col("close"), True, 1.5), f"CASE WHEN close IS NOT NULL THEN greatest(least(CASE WHEN stddev_pop(close) {_CS} > 0 THEN {z} ELSE close - avg(close) {_CS} END, 1.5), -1.5) END")
    legs = (f"centred AS (SELECT *, close - avg(close) {_CS} AS y FROM panel)",)
    _column(
        "cs_scale_legs",
        lambda: cs.scale(cs.normalize(F.col("close")), 1, 2, 3),
        f"CASE WHEN y > 0 THEN y / sum(CASE WHEN y > 0 THEN y END) {_CS} * 2 WHEN y < 0 THEN y / sum(CASE WHEN y < 0 THEN -y END) {_CS} * 3 ELSE y END",
        steps=legs, frm="centred",
    )
    share = f"""ranked AS (SELECT *, {_RANK.format(x="close")} AS rk, count(close) {_CS} AS n FROM panel),
shares AS (SELECT *, CASE WHEN rk IS NOT NULL THEN greatest(least(rk / n, 1 - 0.5 / n), 0.5 / n) END AS p FROM ranked)"""

    # the distribution function by its series, inverted by Newton's steps from a logistic start: no coefficients
    series = "exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 60), lambda k: CASE WHEN z = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END))"
    newton = [f"z{k + 1} AS (SELECT * REPLACE (z - (0.5 + {series} - p) * sqrt(2 * pi()) * exp(z * z / 2) AS z) FROM z{k})" for k in range(6)]
    _column("cs_quantile_gaussian", lambda: cs.quantile(F.col("close")), "CASE WHEN p IS NOT NULL THEN z END", steps=(share, "z0 AS (SELECT *, ln(p / (1 - p)) / 1.7 AS z FROM shares)", *newton), frm="z6")
    _column("cs_quantile_cauchy", lambda: cs.quantile(F.col("close"), "cauchy", 2.0), f"2 * tan({math.pi!r} * (p - 0.5))", steps=(share,), frm="shares")
    _column("cs_quantile_uniform", lambda: cs.quantile(F.col("close"), "uniform"), f"close - avg(close) {_CS}")


_add_cross_section()


# Time series.
def _win(d: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def _roll(f: str, x: str, d: int) -> str:
    return f"CASE WHEN count({x}) {_win(d)} = {d} THEN {f}({x}) {_win(d)} END"


_D = 6
_expression("ts_delay", f"ts_delay(close, {_D})", f"lag(close, {_D}) OVER {TSW}")
_expression("ts_delta", f"ts_delta(close, {_D})", f"close - lag(close, {_D}) OVER {TSW}")
for _f, _s in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std_dev", "stddev_samp")):
    _expression(f"ts_{_f}", f"ts_{_f}(close, {_D})", _roll(_s, "close", _D))
_expression("ts_zscore", f"ts_zscore(close, {_D})", f"CASE WHEN count(close) {_win(_D)} = {_D} THEN (close - avg(close) {_win(_D)}) / nullif(stddev_samp(close) {_win(_D)}, 0) END")
_BOTH = "both_ AS (SELECT *, CASE WHEN volume IS NOT NULL THEN close END AS x, CASE WHEN close IS NOT NULL THEN volume END AS y FROM panel)"
_expression("ts_cov", "ts_cov(close, volume, 8)", f"CASE WHEN count(x) {_win(8)} = 8 THEN round_even(covar_samp(x, y) {_win(8)}, 5) END", steps=(_BOTH,), frm="both_")
_SD = f"(stddev_pop(x) {_win(_D)} * stddev_pop(y) {_win(_D)})"
_expression("ts_corr", f"ts_corr(close, volume, {_D})", f"CASE WHEN count(x) {_win(_D)} = {_D} AND {_SD} > 0 THEN round_even(covar_pop(x, y) {_win(_D)} / {_SD}, 5) END", steps=(_BOTH,), frm="both_")
_LISTS = f"lists AS (SELECT *, list(coalesce(close, 'nan'::DOUBLE)) {_win(_D)} AS a, count(*) {_win(_D)} AS n FROM panel)"
_GAP = "list_position(list_transform(a, lambda v: isnan(v)), true)"
_expression("ts_arg_min", f"ts_arg_min(close, {_D})", f"CASE WHEN n = {_D} THEN CASE WHEN coalesce({_GAP}, 0) > 0 THEN {_GAP} ELSE list_position(a, list_min(a)) END END", steps=(_LISTS,), frm="lists")
_expression("ts_arg_max", f"ts_arg_max(close, {_D})", f"CASE WHEN n = {_D} THEN CASE WHEN coalesce({_GAP}, 0) > 0 THEN {_GAP} ELSE list_position(a, list_max(a)) END END", steps=(_LISTS,), frm="lists")
_expression("ts_rank", f"ts_rank(close, {_D})", f"CASE WHEN n = {_D} THEN len(list_filter(a, lambda v: v <= coalesce(close, 'nan'::DOUBLE))) END", steps=(_LISTS,), frm="lists")
_expression("ts_rolling_rank", f"rolling_rank(trades, {_D})", f"CASE WHEN n = {_D} AND trades IS NOT NULL THEN (len(list_filter(a, lambda v: v < trades)) + 1 + len(list_filter(a, lambda v: v <= trades))) / 2.0 END", steps=(_LISTS.replace("close", "trades"),), frm="lists")
_CHANGES = f"""before AS (SELECT *, lag(trades) OVER {TSW} AS b, row_number() OVER {TSW} AS rn FROM panel),
changes AS (SELECT *, CASE WHEN trades IS NULL OR b IS NULL OR trades <> b THEN rn END AS c FROM before)"""
_expression("ts_days_from_last_change", "days_from_last_change(trades)", f"rn - max(c) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "b", (_CHANGES,), "changes")
_KTH = f"kth AS (SELECT *, list(close) FILTER (close IS NOT NULL) {_win(8)} AS a FROM panel)"
_expression("ts_kth_element", "kth_element(close, 8, 2)", "CASE WHEN len(a) > 0 THEN a[least(2, len(a))] END", "b", (_KTH,), "kth")
_LAST = "prev AS (SELECT *, list(coalesce(trades, 'nan'::DOUBLE)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS a FROM panel), picked AS (SELECT *, list_filter(a, lambda v: isnan(v) <> (trades IS NULL) OR (NOT isnan(v) AND trades IS NOT NULL AND abs(v - trades) > 1e-9)) AS f FROM prev)"
_expression("ts_last_diff_value", "last_diff_value(trades, 8)", "CASE WHEN len(f) > 0 AND NOT isnan(f[len(f)]) THEN f[len(f)] END", "b", (_LAST,), "picked")
_HUMP = """numbered AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM panel),
walk AS (SELECT symbol, ts, rn, close AS v FROM numbered WHERE rn = 1
  UNION ALL SELECT n.symbol, n.ts, n.rn, w.v + greatest(least(n.close - w.v, CASE WHEN n.close IS NOT NULL THEN 0.5 END), CASE WHEN n.close IS NOT NULL THEN -0.5 END) FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"""
_expression("ts_hump", "hump(close, 0.5)", "v", "b", (_HUMP,), "walk")
ORACLE["ts_hump"] = ORACLE["ts_hump"].replace("WITH bars", "WITH RECURSIVE bars", 1).replace("greatest(least(n.close - w.v, CASE WHEN n.close IS NOT NULL THEN 0.5 END), CASE WHEN n.close IS NOT NULL THEN -0.5 END)", "CASE WHEN n.close - w.v IS NOT NULL THEN greatest(least(n.close - w.v, 0.5), -0.5) END")
_PLAIN = f"lists AS (SELECT *, list(close) FILTER (close IS NOT NULL) {_win(_D)} AS a, count(close) {_win(_D)} AS n FROM panel)"
_expression("ts_product", f"ts_product(divide(close, open), {_D})", f"CASE WHEN n = {_D} THEN list_product(a) END", steps=(f"lists AS (SELECT *, list(close / open) FILTER (close IS NOT NULL) {_win(_D)} AS a, count(close) {_win(_D)} AS n FROM panel)",), frm="lists")
_expression("ts_decay_linear", f"ts_decay_linear(close, {_D})", f"CASE WHEN n = {_D} THEN (" + " + ".join(f"{k} * a[{k}]" for k in range(1, _D + 1)) + f") / {_D * (_D + 1) / 2} END", steps=(_PLAIN,), frm="lists")
_expression("ts_regression", f"ts_regression(close, volume, {_D})", f"CASE WHEN count(x) {_win(_D)} = {_D} AND var_pop(y) {_win(_D)} > 0 THEN covar_pop(x, y) {_win(_D)} / var_pop(y) {_win(_D)} END", steps=(_BOTH,), frm="both_")
_expression("ts_scale", f"ts_scale(close, {_D})", f"CASE WHEN count(close) {_win(_D)} = {_D} THEN (close - min(close) {_win(_D)}) / nullif(max(close) {_win(_D)} - min(close) {_win(_D)}, 0) END")


def _ts_quantile_sql() -> str:
    values = []
    from statistics import NormalDist

    for k in range(2, 2 * _D + 1):
        p = min(max(k / 2 / _D, 0.5 / _D), 1 - 0.5 / _D)
        values.append(f"WHEN {k} THEN {NormalDist().inv_cdf(p)!r}")
    twice = "CAST(len(list_filter(a, lambda v: v < close)) + 1 + len(list_filter(a, lambda v: v <= close)) AS INTEGER)"
    return f"CASE WHEN n = {_D} THEN CASE {twice} {' '.join(values)} END END"


_expression("ts_quantile", f"ts_quantile(close, {_D})", _ts_quantile_sql(), steps=(_PLAIN,), frm="lists")
_expression("expr_nested", "rank(ts_delta(divide(close, volume), 3))", _RANK.format(x="y"), steps=(f"moved3 AS (SELECT *, close / volume - lag(close / volume, 3) OVER {TSW} AS y FROM panel)",), frm="moved3")
_expression(
    "expr_two_levels", "ts_mean(rank(ts_sum(volume, 3)), 4)", f"CASE WHEN count(rk) {_win(4)} = 4 THEN avg(rk) {_win(4)} END",
    steps=(f"sums AS (SELECT *, CASE WHEN count(volume) {_win(3)} = 3 THEN sum(volume) {_win(3)} END AS y FROM panel)", f"ranks AS (SELECT *, {_RANK.format(x='y')} AS rk FROM sums)"), frm="ranks",
)


def _query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLE[name] = sql
        return f

    return add


@_query("panel_dense", _with("b") + "SELECT symbol, ts, round_even(open * 1e6, 0) / 1e6 AS open, round_even(close * 1e6, 0) / 1e6 AS close, round_even(volume * 1e6, 0) / 1e6 AS volume, trades FROM panel")
def _(spark, sf_dir):
    return panel_b(spark, sf_dir).densify().df.select("symbol", "ts", *[rounded(F.col(c)).alias(c) for c in ("open", "close", "volume")], "trades")


@_query("panel_forward_returns", _with("a", RETURNS_SQL) + "SELECT symbol, ts, round_even(fwd_ret * 1e6, 0) / 1e6 AS v FROM full_ret")
def _(spark, sf_dir):
    return panel_a(spark, sf_dir).densify().forward_returns().df.select("symbol", "ts", rounded(F.col("fwd_ret")).alias("v"))


@_query("panel_trim", _with("a", RETURNS_SQL) + "SELECT symbol, ts, round_even(fwd_ret * 1e6, 0) / 1e6 AS v FROM ret")
def _(spark, sf_dir):
    return panel_a(spark, sf_dir).densify().forward_returns().trim().df.select("symbol", "ts", rounded(F.col("fwd_ret")).alias("v"))


# Metrics of rank(ts_delta(close, 3)) against the next bar's return.
FACTOR = "rank(ts_delta(close, 3))"


def scored(panel: Callable, spark: SparkSession, sf_dir: str) -> Panel:
    return evaluate(panel(spark, sf_dir).densify().forward_returns().trim(), {"f": FACTOR})


_FACTOR_SQL = (
    RETURNS_SQL,
    f"deltas AS (SELECT *, close - lag(close, 3) OVER {TSW} AS y FROM ret)",
    f"factor AS (SELECT *, {_RANK.format(x='y')} AS f, fwd_ret AS r FROM deltas)",
    "pairs AS (SELECT symbol, ts, f, r FROM factor WHERE f IS NOT NULL AND r IS NOT NULL)",
    f"pair_ranks AS (SELECT *, {_RANK.format(x='f')} AS fr, {_RANK.format(x='r')} AS rr FROM pairs)",
)
_CORR = "CASE WHEN count(*) > 1 AND stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
_IC = f"ic AS (SELECT ts, {_CORR.format(x='f', y='r')} AS v FROM pairs GROUP BY ts)"
_RIC = f"ric AS (SELECT ts, {_CORR.format(x='fr', y='rr')} AS v FROM pair_ranks GROUP BY ts)"
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY f, symbol) AS place, count(*) OVER (PARTITION BY ts) AS n FROM pairs)"
_TOPK = """tops AS (SELECT *, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS k FROM placed WHERE n >= 10),
topk AS (SELECT ts, greatest(avg(CASE WHEN place > n - k THEN r END), avg(CASE WHEN place <= k THEN r END)) - avg(r) AS v FROM tops GROUP BY ts)"""
_MONO = """grouped AS (SELECT *, ntile(10) OVER (PARTITION BY ts ORDER BY f, symbol) AS g FROM placed WHERE n >= 10),
gmeans AS (SELECT ts, g, avg(r) AS m FROM grouped GROUP BY ts, g),
gdiffs AS (SELECT ts, m - lag(m) OVER (PARTITION BY ts ORDER BY g) AS d FROM gmeans),
mono AS (SELECT ts, greatest(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END), sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)) / 10.0 AS v FROM gdiffs GROUP BY ts)"""
_HML = """legs AS (SELECT *, CAST(floor(n * {share}) AS BIGINT) AS k FROM placed WHERE n >= 10),
hml_all AS (SELECT ts, avg(CASE WHEN place > n - k AND r > -1 THEN ln(1 + r) END) - avg(CASE WHEN place <= k AND r > -1 THEN ln(1 + r) END) AS v, max(n) > 10 AND count(DISTINCT f) < 5 AS flat FROM legs GROUP BY ts),
hml AS (SELECT ts, v FROM hml_all WHERE v IS NOT NULL AND NOT (SELECT coalesce(bool_or(flat), false) FROM hml_all))"""


def _series(name: str, sql: tuple[str, ...], frm: str, f: Callable[[Panel], DataFrame], panel: str = "a") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(scored(PANELS[panel], spark, sf_dir)).select("ts", rounded(F.col("value")).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _with(panel, *_FACTOR_SQL, *sql) + f"SELECT ts, {rounded_sql('v')} AS v FROM {frm}"


def _single(name: str, sql: tuple[str, ...], select: str, f: Callable[[Panel], DataFrame], panel: str = "a") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(scored(PANELS[panel], spark, sf_dir)).select(rounded(F.col("value")).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _with(panel, *_FACTOR_SQL, *sql) + f"SELECT round_even(CAST({select} * 1e6, 0) / 1e6 AS v"


def _one(value: str, frm: str) -> str:
    return f"(SELECT {value} FROM {frm}) AS DOUBLE)"


_series("m_ic", (_IC,), "ic", lambda p: M.ic(p, "f", "fwd_ret"))
_series("m_rankic", (_RIC,), "ric", lambda p: M.rank_ic(p, "f", "fwd_ret"))
_single("m_icir", (_IC,), _one("coalesce(avg(v) / nullif(stddev_pop(v), 0), 0)", "ic"), lambda p: M.information_ratio(M.ic(p, "f", "fwd_ret")))
_single("m_rankic_mean", (_RIC,), _one("avg(v)", "ric"), lambda p: M.mean(M.rank_ic(p, "f", "fwd_ret")))
_TURN = f"lagged AS (SELECT ts, f AS x, lag(f) OVER {TSW} AS y FROM factor), turns AS (SELECT ts, CASE WHEN sum(abs(y)) > 0 THEN sum(abs(x - y)) / sum(abs(y)) ELSE 0 END AS v FROM lagged WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ts)"
_single("m_turnover", (_TURN,), _one("avg(v)", "turns"), lambda p: M.turnover(p, "f"))
_single("m_top_k", (_PLACED, _TOPK), _one("avg(v)", "topk"), lambda p: M.top_k_returns(p, "f", "fwd_ret"))
_single("m_monotonicity", (_PLACED, _MONO), _one("avg(v)", "mono"), lambda p: M.monotonicity(p, "f", "fwd_ret"))
_series("m_high_minus_low", (_PLACED, _HML.format(share=0.5)), "hml", lambda p: M.high_minus_low(p, "f", "fwd_ret", 0.5), "c")
_LEGS = (_PLACED, _HML.format(share=0.1))
_FLOOR = repr(math.log(1.01))
_single("m_sharpe", _LEGS, _one(f"CASE WHEN count(*) >= 750 THEN (avg(v) * sqrt(252) - {_FLOOR}) / nullif(stddev_samp(v) * sqrt(252), 0) END", "hml"), lambda p: M.sharpe(p, "f", "fwd_ret"), "c")
_DOWN = "cum AS (SELECT ts, v, sum(v) OVER (ORDER BY ts) AS total FROM hml), downs AS (SELECT v, total - max(total) OVER (ORDER BY ts) AS down FROM cum)"
_single("m_calmar", (*_LEGS, _DOWN), _one("CASE WHEN count(*) >= 750 THEN avg(v) * sqrt(252) / nullif(abs(min(down)), 0) END", "downs"), lambda p: M.calmar(p, "f", "fwd_ret"), "c")
_single("m_sortino", _LEGS, _one(f"CASE WHEN count(*) >= 750 THEN (avg(v) * sqrt(252) - {_FLOOR}) / nullif(stddev_samp(CASE WHEN v < {_FLOOR} THEN v END) * sqrt(252), 0) END", "hml"), lambda p: M.sortino(p, "f", "fwd_ret"), "c")
_single(
    "m_fitness_weighted", (_RIC, _PLACED, _TOPK, _MONO), "coalesce(0.5 * (SELECT avg(v) FROM ric) + 0.3 * (SELECT avg(v) FROM topk) + 0.2 * (SELECT avg(v) FROM mono), -1) AS DOUBLE)",
    lambda p: M.weighted_fitness(p, "f", "fwd_ret", {"rankic": 0.5, "top_r": 0.3, "mono": 0.2}),
)
_single("m_fitness_correlation", (_RIC,), _one("coalesce(avg(v), '-inf'::DOUBLE)", "ric"), lambda p: M.correlation_fitness(p, "f", "fwd_ret"))


# One generation of the search: the mean rank IC of eight expressions, from one job.
_POPULATION = {
    "rank(close)": _RANK.format(x="close"),
    "ts_delay(close, 3)": f"lag(close, 3) OVER {TSW}",
    "divide(close, volume)": "CASE WHEN volume = 0 THEN 1e6 ELSE close / volume END",
    "ts_mean(volume, 3)": _roll("avg", "volume", 3),
    "reverse(close)": "-close",
    "subtract(high, low)": "high - low",
    "ts_sum(trades, 4)": _roll("sum", "trades", 4),
    "multiply(close, volume)": "close * volume",
}


def _population_sql() -> str:
    parts = []
    for e, sql in _POPULATION.items():
        pairs = f"(SELECT * FROM (SELECT symbol, ts, {sql} AS f, fwd_ret AS r FROM ret) WHERE f IS NOT NULL AND r IS NOT NULL)"
        ranks = f"(SELECT ts, {_RANK.format(x='f')} AS fr, {_RANK.format(x='r')} AS rr FROM {pairs})"
        parts.append(f"SELECT '{e}' AS expression, round_even(avg(v) * 1e6, 0) / 1e6 AS fitness FROM (SELECT ts, {_CORR.format(x='fr', y='rr')} AS v FROM {ranks} GROUP BY ts)")
    return _with("a", RETURNS_SQL) + " UNION ALL ".join(parts)


@_query("gp_population_fitness", _population_sql())
def _(spark, sf_dir):
    panel = panel_a(spark, sf_dir).densify().forward_returns().trim()
    trees = [parse(e, native(), panel.fields) for e in _POPULATION]
    fitness = gp.rank_ic_fitness(panel, trees, native())
    rows = spark.createDataFrame([(e, fitness[str(t)]) for e, t in zip(_POPULATION, trees, strict=True)], "expression string, fitness double")
    return rows.select("expression", rounded(F.col("fitness")).alias("fitness"))


@_query("stream_bars", "SELECT user_id AS symbol, CAST(ts AS DATE) AS ts, max(value) AS high, min(value) AS low, round_even(sum(value) * 1e6, 0) / 1e6 AS volume, count(*) AS trades FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(spark, sf_dir):
    """Daily bars of the stream of events that have landed, those that the watermark has closed."""
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # the table's times have no zone: they are taken as UTC, whatever the session's is
    seconds = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    events = events.withColumn("ts", F.timestamp_seconds(seconds))
    folder = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex[:12]}"
    bars_ = updates.tumbling_bars(events, "1 day", "1 hour", "user_id", "ts", "value", "value")
    updates.append_stream(bars_, f"{folder}/bars", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(bars_.schema).parquet(f"{folder}/bars").select("symbol", F.date_from_unix_date((F.unix_seconds("ts") / 86400).cast("int")).alias("ts"), "high", "low", rounded(F.col("volume")).alias("volume"), "trades")


#: The two-sided 5 % point of the normal distribution bounds that of t from below; from 10,000 pairs on they agree to 4 digits.
_SPEARMAN = "WITH one AS (SELECT 0 AS ts, {x} AS f, {y} AS r FROM lineitem), ranked AS (SELECT {rf} AS fr, {rr} AS rr FROM one), rho AS (SELECT {corr} AS v, count(*) AS n FROM ranked) SELECT round_even((CASE WHEN v IS NOT NULL AND abs(v) * sqrt((n - 2) / (1 - v * v)) > 1.96 THEN v ELSE 0 END) * 1e6, 0) / 1e6 AS v FROM rho"


def _spearman(name: str, x: str, y: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "lineitem").select(F.expr(x).alias("x"), F.expr(y).alias("y"))
        return M.spearman_corr(df, "x", "y").select(rounded(F.col("value")).alias("v"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = _SPEARMAN.format(x=x, y=y, rf=_RANK.format(x="f"), rr=_RANK.format(x="r"), corr=_CORR.format(x="fr", y="rr"))


_spearman("m_spearman", "l_extendedprice", "l_extendedprice / l_quantity")
_spearman("m_spearman_insignificant", "l_tax", "l_quantity")


# The store: daily bars of events, as stored rows.
def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("timestamp")
    return panel_d(spark, sf_dir).df.select(F.col("symbol").cast("string").alias("symbol"), ms, *[rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])


_STORED = "WITH " + BARS_SQL["d"] + ", stored AS (SELECT symbol::VARCHAR AS symbol, CAST(datediff('day', DATE '1970-01-01', ts) AS BIGINT) * 86400000 AS timestamp, round_even(open * 1e6, 0) / 1e6 AS open, round_even(high * 1e6, 0) / 1e6 AS high, round_even(low * 1e6, 0) / 1e6 AS low, round_even(close * 1e6, 0) / 1e6 AS close, round_even(volume * 1e6, 0) / 1e6 AS volume FROM bars)"
_FROM, _TO = 1704672000000, 1705276800000  # 2024-01-08 and 2024-01-15
_NEW = f", newer AS (SELECT symbol, timestamp, open, high, low, close * 2 AS close, volume FROM stored WHERE timestamp >= {_TO} UNION ALL SELECT * FROM stored WHERE timestamp = {_FROM})"


def _revised(s: DataFrame) -> DataFrame:
    return s.where(F.col("timestamp") >= _TO).withColumn("close", F.col("close") * 2).unionByName(s.where(F.col("timestamp") == _FROM))


def _store(spark: SparkSession, rows: DataFrame) -> klines.KlineStore:
    """A store of its own in the shared folder, with these rows in it."""
    store = klines.KlineStore(spark, f"{shared_folder(spark)}/panel-{uuid.uuid4().hex[:12]}/store")
    store.upsert(_keyed(rows))
    return store


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"open_time": F.col("timestamp"), "exchange": F.lit("x"), "kline_type": F.lit("swap"), "interval": F.lit("1d")})


_BAR = ("symbol", "timestamp", "open", "high", "low", "close", "volume")


@_query("store_read_range", _STORED + f" SELECT * FROM stored WHERE timestamp BETWEEN {_FROM} AND {_TO}")
def _(spark, sf_dir):
    return _store(spark, _stored(spark, sf_dir)).read(start=_FROM, end=_TO).select(*_BAR)


@_query("store_read_multi", _STORED + f" SELECT * FROM stored WHERE symbol IN ('1', '5', '9') AND timestamp >= {_FROM} ORDER BY timestamp, symbol")
def _(spark, sf_dir):
    return _store(spark, _stored(spark, sf_dir)).read(["1", "5", "9"], _FROM, exchange="x", interval="1d").select(*_BAR).orderBy("timestamp", "symbol")


@_query("store_upsert", _STORED + _NEW + " SELECT * FROM newer UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.symbol = s.symbol AND n.timestamp = s.timestamp)")
def _(spark, sf_dir):
    """Written, revised twice by the same rows, and read back."""
    rows = stage(_stored(spark, sf_dir), "stored")
    store = _store(spark, rows)
    for _ in range(2):
        store.upsert(_keyed(_revised(rows)))
    return store.read().select(*_BAR)


@_query("store_upsert_exact", _STORED + _NEW + " SELECT DISTINCT * FROM (SELECT * FROM stored UNION ALL SELECT * FROM newer)")
def _(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return klines.merged(s, _revised(s), "exact", ("symbol",))


@_query("store_upsert_latest", _STORED + _NEW + " SELECT * FROM newer UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.symbol = s.symbol AND n.timestamp = s.timestamp)")
def _(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return klines.merged(s, _revised(s), "latest", ("symbol",))


@_query("store_high_water_mark", _STORED + " SELECT symbol, max(timestamp) AS last_ts FROM stored GROUP BY symbol")
def _(spark, sf_dir):
    return _store(spark, _stored(spark, sf_dir)).high_water_mark().select("symbol", "last_ts")


@_query("store_incremental", _STORED + f" SELECT s.* FROM stored s LEFT JOIN (SELECT symbol, max(timestamp) AS m FROM stored WHERE timestamp < {_TO} GROUP BY symbol) USING (symbol) WHERE m IS NULL OR timestamp > m")
def _(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return klines.newer_than(s, klines.high_water_mark(s.where(F.col("timestamp") < _TO), ("symbol",)), ("symbol",))


@_query("store_parse_time", "SELECT o_orderkey, o_custkey, o_totalprice, epoch_ms(o_orderdate::TIMESTAMP) // 1000 * 1000 AS a, CAST(epoch_ms(o_orderdate::DATE::TIMESTAMP) AS BIGINT) AS b FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz"))
    a, b = F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.date_format("t", "yyyyMMdd")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", timeparse.parse_time_column(a).alias("a"), timeparse.parse_time_column(b).alias("b"))


@_query("store_ms_to_date", _STORED + " SELECT symbol, timestamp, strftime(DATE '1970-01-01' + CAST(timestamp // 86400000 AS INTEGER), '%Y-%m-%d') AS d FROM stored")
def _(spark, sf_dir):
    return _stored(spark, sf_dir).select("symbol", "timestamp", timeparse.ms_to_date(F.col("timestamp")).alias("d"))


@_query("store_suffix_filter", "SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand LIKE '%3' ORDER BY 1")
def _(spark, sf_dir):
    return klines.trading_pairs(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")), "3")


@_query("store_catalog", _STORED + " SELECT DISTINCT 'x' AS exchange, symbol, 'swap' AS kline_type, '1d' AS interval, 'exchange=x/symbol=' || symbol || '/kline_type=swap/interval=1d' AS path FROM stored")
def _(spark, sf_dir):
    store = _store(spark, _stored(spark, sf_dir))
    return store.catalog().withColumn("path", F.substring_index("path", "/store/", -1))


@_query("store_zips", _STORED + " SELECT * FROM stored")
def _(spark, sf_dir):
    """The bars of each symbol as a zipped CSV file beside one that cannot be read, read back."""
    folder = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex[:12]}/zips"
    _stored(spark, sf_dir).repartition("symbol").sortWithinPartitions("symbol", "timestamp").mapInArrow(_zipped, "name string, content binary").write.parquet(folder)
    bars = ingest.open_zips(spark.read.parquet(folder).select(F.col("name").alias("path"), "content").union(spark.createDataFrame([("BAD-1d-2024-01-01.zip", bytearray(b"no zip"))], "path string, content binary")))
    bars = klines.canonical(bars.where("error is null")).withColumn("symbol", ingest.file_symbol(F.col("file")))
    return bars.withColumn("timestamp", F.col("open_time")).select(*_BAR)


def _zipped(batches):
    """One zip of CSV per symbol of sorted bars."""
    def done(symbol: str, rows: list[str]):
        import pyarrow as pa

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("bars.csv", "\n".join(rows) + "\n")
        return pa.RecordBatch.from_arrays([pa.array([f"{symbol}-1d-2024-01-31.zip"]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    own, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["symbol"] != own:
                if rows:
                    yield done(own, rows)
                own, rows = r["symbol"], []
            rows.append(",".join([str(r["timestamp"]), *[repr(r[c]) for c in ("open", "high", "low", "close", "volume")], "", "", "", "", "", ""]))
    if rows:
        yield done(own, rows)


@_query("store_retry_list", "SELECT DISTINCT event_type AS symbol, CAST(user_id % 3 AS VARCHAR) AS interval, 'swap' AS kline_type FROM events")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 3).cast("string").alias("interval"), F.lit("swap").alias("kline_type"))
    return klines.retry_list(e)


@_query("store_canonical", "SELECT l_orderkey AS open_time, l_extendedprice AS open, CAST(l_linenumber AS BIGINT) AS trades FROM lineitem")
def _(spark, sf_dir):
    raw = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("open_time"), F.col("l_extendedprice").cast("string").alias("open"), F.col("l_linenumber").cast("string").alias("count"))
    header = spark.createDataFrame([("open_time", "open", "count")], "open_time string, open string, count string")
    return klines.canonical(raw.union(header))


# Daily bars whose late ones are made flat and empty, for some users.
def _tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("timestamp") > _TO) & (F.col("symbol").cast("int") % 3 == 0)
    s = _stored(spark, sf_dir)
    return s.select("symbol", "timestamp", *[F.when(late, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.when(late, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"))


_LATE = f"timestamp > {_TO} AND CAST(symbol AS INTEGER) % 3 = 0"
_TAILED = _STORED + ", tailed AS (SELECT symbol, timestamp, " + ", ".join(f"CASE WHEN {_LATE} THEN 1.0 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close")) + f", CASE WHEN {_LATE} THEN 0.0 ELSE volume END AS volume FROM stored), real_ AS (SELECT symbol, max(CASE WHEN NOT (open = high AND high = low AND low = close AND volume = 0) THEN timestamp END) AS last_real FROM tailed GROUP BY symbol)"


@_query("q_fake_tail_detect", _TAILED + " SELECT t.symbol, any_value(last_real) AS last_real, count(*) AS bars, CAST(sum(CASE WHEN last_real IS NULL OR timestamp > last_real THEN 1 ELSE 0 END) AS BIGINT) AS fake_tail FROM tailed t JOIN real_ r ON t.symbol = r.symbol GROUP BY t.symbol")
def _(spark, sf_dir):
    return quality.fake_tails(_tailed(spark, sf_dir))


@_query("q_fake_tail_cleanup", _TAILED + " SELECT t.* FROM tailed t JOIN real_ r ON t.symbol = r.symbol WHERE CAST(t.symbol AS INTEGER) % 2 = 0 OR timestamp <= last_real")
def _(spark, sf_dir):
    t = _tailed(spark, sf_dir)
    return quality.cleanup(t, t.where(F.col("symbol").cast("int") % 2 == 0).select("symbol").distinct()).select(*t.columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, and mean over deviation, of the rank IC of FACTOR against the next bar's return."""
    series = M.rank_ic(scored(panel_a, spark, sf_dir), "f", "fwd_ret")
    return series.agg(rounded(F.avg("value")).alias("rank_ic"), rounded(F.coalesce(F.avg("value") / F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(0.0))).alias("rank_icir"), F.count("value").alias("periods"))


QUERIES["flagship_rank_ic"] = flagship
ORACLE["flagship_rank_ic"] = _with("a", *_FACTOR_SQL, _RIC) + "SELECT round_even(avg(v) * 1e6, 0) / 1e6 AS rank_ic, round_even(coalesce(avg(v) / nullif(stddev_pop(v), 0), 0) * 1e6, 0) / 1e6 AS rank_icir, count(v) AS periods FROM ric"
