"""Time-series operators: trailing rows of one symbol on the dense grid, so frames are rows.

The rolling statistics need d rows, all finite; the positional ones need d rows only, and see a missing
value as NaN. A window longer than the series is missing everywhere."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.nulls import all_present, clean, fin, safe_div
from panelforge.functions.probit import probit


def _order(symbol: str, ts: str):
    return Window.partitionBy(symbol).orderBy(ts)


def _trail(d: int, symbol: str, ts: str):
    return _order(symbol, ts).rowsBetween(-(int(d) - 1), Window.currentRow)


def _full(d: int, w, *xs: Column) -> Column:
    return F.count(F.when(all_present(*[fin(x) for x in xs]), 1)).over(w) == int(d)


def _roll(x: Column, d: int, symbol: str, ts: str, f) -> Column:
    w = _trail(d, symbol, ts)
    return F.when(_full(d, w, x), clean(f(fin(x)).over(w)))


def ts_delay(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return F.lag(x, int(d)).over(_order(symbol, ts))


def ts_delta(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return clean(x - ts_delay(x, d, symbol, ts))


def ts_sum(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return _roll(x, d, symbol, ts, F.sum)


def ts_mean(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return _roll(x, d, symbol, ts, F.avg)


def ts_min(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return _roll(x, d, symbol, ts, F.min)


def ts_max(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return _roll(x, d, symbol, ts, F.max)


def ts_std_dev(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Sample deviation; missing for d = 1."""
    return _roll(x, d, symbol, ts, F.stddev_samp)


def ts_zscore(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    return safe_div(fin(x) - ts_mean(x, d, symbol, ts), ts_std_dev(x, d, symbol, ts))


def ts_cov(x: Column, y: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Sample covariance, rounded half to even to 5 places."""
    w = _trail(d, symbol, ts)
    return F.when(_full(d, w, x, y), F.bround(clean(F.covar_samp(fin(x), fin(y)).over(w)), 5))


def ts_corr(x: Column, y: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Pearson correlation, rounded half to even to 5 places; missing where either side is constant."""
    w = _trail(d, symbol, ts)
    x, y = fin(x), fin(y)
    sd = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when(_full(d, w, x, y), F.bround(safe_div(F.covar_pop(x, y).over(w), sd), 5))


def _list(x: Column, w) -> Column:
    return F.collect_list(F.coalesce(x, F.lit(float("nan")))).over(w)


def _held(d: int, w, out: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(w) == int(d), out)


def ts_arg_min(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Place of the least value in the window, 1 the oldest, the first of equals; a missing value wins."""
    w = _trail(d, symbol, ts)
    a = _list(x, w)
    gap = F.array_position(a, float("nan"))
    return _held(d, w, F.when(gap > 0, gap).otherwise(F.array_position(a, F.array_min(a))).cast("double"))


def ts_arg_max(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    w = _trail(d, symbol, ts)
    a = _list(x, w)
    return _held(d, w, F.array_position(a, F.array_max(a)).cast("double"))


def ts_rank(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Ordinal rank of the newest value in the window, after its equals; missing values sort last."""
    w = _trail(d, symbol, ts)
    last = F.coalesce(x, F.lit(float("nan")))
    return _held(d, w, F.size(F.filter(_list(x, w), lambda v: v <= last)).cast("double"))


def rolling_rank(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Average rank of the newest value in the window."""
    w = _trail(d, symbol, ts)
    a = _list(x, w)
    return _held(d, w, F.when(x.isNotNull(), (F.size(F.filter(a, lambda v: v < x)) + 1 + F.size(F.filter(a, lambda v: v <= x))) / 2.0))


def days_from_last_change(x: Column, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Rows since the value last differed from the one before; a missing value is always a change."""
    w = _order(symbol, ts)
    row = F.row_number().over(w)
    before = F.lag(x).over(w)
    changed = x.isNull() | before.isNull() | (x != before)
    last = F.max(F.when(changed, row)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (row - last).cast("double")


def kth_element(x: Column, d: int, k: int = 1, symbol: str = "symbol", ts: str = "ts") -> Column:
    """The k-th present value of the last d rows, oldest first; the last one if there are fewer."""
    a = F.collect_list(x).over(_trail(d, symbol, ts))
    return F.get(a, F.least(F.lit(int(k)), F.size(a)) - 1)


def last_diff_value(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """The newest of the d values before that differs from the current one by over 1e-9; a missing and a
    present value differ, two missing ones do not."""
    a = F.collect_list(F.coalesce(x, F.lit(float("nan")))).over(_order(symbol, ts).rowsBetween(-int(d), -1))
    gone = x.isNull()
    return clean(F.try_element_at(F.filter(a, lambda v: (F.isnan(v) != gone) | (~F.isnan(v) & ~gone & (F.abs(v - x) > 1e-9))), F.lit(-1)))


def ts_product(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    w = _trail(d, symbol, ts)
    return F.when(_full(d, w, x), clean(F.aggregate(F.collect_list(fin(x)).over(w), F.lit(1.0), lambda p, v: p * v)))


def ts_decay_linear(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Mean with weights 1 to d, the newest the heaviest."""
    d = int(d)
    w = _trail(d, symbol, ts)
    weighted = F.zip_with(F.collect_list(fin(x)).over(w), F.sequence(F.lit(1), F.lit(d)), lambda v, k: v * k)
    return F.when(_full(d, w, x), F.aggregate(weighted, F.lit(0.0), lambda p, v: p + v) / (d * (d + 1) / 2.0))


def ts_quantile(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """The gaussian quantile of the newest value's average rank in the window (our reading of the name)."""
    w = _trail(d, symbol, ts)
    share = rolling_rank(x, d, symbol, ts) / float(d)
    half = 0.5 / int(d)
    return F.when(_full(d, w, x), probit(F.greatest(F.least(share, F.lit(1 - half)), F.lit(half))))


def ts_regression(y: Column, x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Slope of y on x (our reading of the name); missing for a constant x."""
    w = _trail(d, symbol, ts)
    x, y = fin(x), fin(y)
    return F.when(_full(d, w, x, y), safe_div(F.covar_pop(y, x).over(w), F.var_pop(x).over(w)))


def ts_scale(x: Column, d: int, symbol: str = "symbol", ts: str = "ts") -> Column:
    """Place between the window's least and greatest value (our reading of the name)."""
    low, high = ts_min(x, d, symbol, ts), ts_max(x, d, symbol, ts)
    return safe_div(fin(x) - low, high - low)


def hump(df: DataFrame, x: str, out: str, hump: float = 0.01, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """df with a column ``out``: x followed by steps of at most ``hump``; from a missing value on, missing.
    Each value depends on the one before it, which no window expresses: rows are streamed in order."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    at, key = df.columns.index(x), df.columns.index(symbol)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for b in batches:
            got = []
            for s, v in zip(b.column(key).to_pylist(), b.column(at).to_pylist(), strict=True):
                if s != own:
                    own, last = s, v
                elif last is None or v is None:
                    last = None
                else:
                    step = v - last
                    last = last + (hump if step > hump else -hump if step < -hump else step)
                got.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return df.repartition(symbol).sortWithinPartitions(symbol, ts).mapInArrow(run, schema)
