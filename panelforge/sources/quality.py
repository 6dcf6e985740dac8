"""Bars that only repeat a last price: their tail, after a symbol's delisting, is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_fake() -> Column:
    """Open, high, low and close are equal and volume is zero; false where any is missing."""
    return F.coalesce((F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close")) & (F.col("volume") == 0), F.lit(False))


def fake_tails(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Per key: last_real (the last timestamp of a real bar, null if there is none), bars, fake_tail."""
    real = df.groupBy(*keys).agg(F.max(F.when(~is_fake(), F.col(ts))).alias("last_real"))
    out = df.select(*keys, ts).join(real, list(keys))
    late = F.col("last_real").isNull() | (F.col(ts) > F.col("last_real"))
    return out.groupBy(*keys).agg(F.first("last_real").alias("last_real"), F.count("*").alias("bars"), F.sum(F.when(late, 1).otherwise(0)).alias("fake_tail"))


def cleanup_report(df: DataFrame, active: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Per key: action ("truncate", "keep active", "clean"), bars before and after."""
    tails = fake_tails(df, keys, ts).join(active.select("symbol").distinct().withColumn("active", F.lit(True)), "symbol", "left")
    cut = (F.col("fake_tail") > 0) & F.col("active").isNull()
    action = F.when(F.col("fake_tail") == 0, "clean").when(cut, "truncate").otherwise("keep active")
    return tails.select(*keys, action.alias("action"), F.col("bars").alias("before"), (F.col("bars") - F.when(cut, F.col("fake_tail")).otherwise(0)).alias("after"), "last_real")


def cleanup(df: DataFrame, active: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """df without the fake tails of symbols that are not active. An empty active list is an error: it would
    make every symbol a delisted one."""
    if active.isEmpty():
        raise ValueError("no active symbols")
    report = cleanup_report(df, active, keys, ts).where("action = 'truncate'").select(*keys, "last_real", F.lit(True).alias("cut"))
    out = df.join(report, list(keys), "left")
    return out.where(F.col("cut").isNull() | (F.col(ts) <= F.col("last_real"))).drop("cut", "last_real")
