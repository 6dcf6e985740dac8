"""The panel: one row per (symbol, timestamp), dense, with numeric fields."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.nulls import clean
from panelforge.sources.stages import stage

#: A time axis of up to so many timestamps is one array; a longer one stays a table.
MAX_AXIS = 1_000_000


@dataclass(frozen=True)
class Panel:
    """df has columns symbol, ts and fields; other columns are carried along."""

    df: DataFrame
    fields: tuple[str, ...]
    symbol: str = "symbol"
    ts: str = "ts"
    #: The distinct timestamps, where they are known without the data.
    axis: DataFrame | None = None

    def times(self) -> DataFrame:
        """The distinct timestamps."""
        return self.df.select(self.ts).distinct() if self.axis is None else self.axis

    def densify(self) -> Panel:
        """Every symbol at every timestamp, missing cells NULL: data and grid meet in one shuffle on (symbol, ts). The
        time axis, if it has at most MAX_AXIS timestamps, is one array, exploded per symbol."""
        times, symbols = self.times(), self.df.select(self.symbol).distinct()
        if times.limit(MAX_AXIS + 1).count() <= MAX_AXIS:
            every = times.agg(F.sort_array(F.collect_list(self.ts)).alias("t"))
            grid = symbols.select(self.symbol, F.explode_outer(every.scalar()).alias(self.ts))
        else:
            grid = symbols.crossJoin(times)  # its rows are the result's
        keep = [self.symbol, self.ts, *self.fields]
        return replace(self, df=grid.join(self.df.select(*keep), [self.symbol, self.ts], "left"), axis=times)

    def forward_returns(self, period: int = 1, price: str = "open", out: str = "fwd_ret") -> Panel:
        """(open[t+1+period] - open[t+1]) / open[t+1] on the dense grid."""
        if period <= 0:
            raise ValueError("period must be positive")
        w = Window.partitionBy(self.symbol).orderBy(self.ts)
        first, last = F.lead(price, 1).over(w), F.lead(price, 1 + period).over(w)
        return replace(self, df=self.df.withColumn(out, clean((last - first) / F.when(first != 0, first))))

    def trim(self, period: int = 1) -> Panel:
        """Without the last period + 1 timestamps, whose forward returns cannot be known."""
        times = self.times()
        last = times.orderBy(F.desc(self.ts)).limit(period + 1).agg(F.min(self.ts).alias("t"))
        before = lambda df: df.where(F.col(self.ts) < last.scalar())
        return replace(self, df=before(self.df), axis=before(times))


def union_sources(frames: list[DataFrame], tag: str = "symbol") -> DataFrame:
    """Several sources as one: columns united by name, and the source's number from 1 as tag where a
    source has no such column."""
    out = None
    for i, f in enumerate(frames, 1):
        f = f if tag in f.columns else f.withColumn(tag, F.lit(str(i)))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def bars(df: DataFrame, symbol, ts, price, volume, amount, order: list) -> Panel:
    """Open, high, low, close, volume, quote volume and trades of each (symbol, ts) of a table of trades;
    ``order`` is the total order that decides what comes first and last. The trades are read once: bars are staged,
    and the panel's axes come from them."""
    key = F.struct(*order)
    rows = df.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("price"), volume.alias("v"), amount.alias("a"), key.alias("key"))
    out = rows.groupBy("symbol", "ts").agg(
        F.min_by("price", "key").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "key").alias("close"),
        F.sum("v").alias("volume"),
        F.sum("a").alias("quote_volume"),
        F.count("*").cast("double").alias("trades"),
    )
    return Panel(stage(out, "bars"), ("open", "high", "low", "close", "volume", "quote_volume", "trades"))
