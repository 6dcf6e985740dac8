"""Continuous maintenance of the bar store, and bars of event streams (an extension)."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelforge.sources.ingest import open_zips
from panelforge.sources.klines import KEYS, KlineStore, canonical, stamped
from panelforge.sources.loaders import PagedBars
from panelforge.sources.stages import stage, unstage


def bar_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of CSV files as they land."""
    return spark.readStream.schema(schema).option("header", "false").option("maxFilesPerTrigger", files_per_batch).csv(path)


def upsert_stream(stream: DataFrame, store: KlineStore, checkpoint: str, keys: dict[str, str] | None = None, mode: str = "latest") -> StreamingQuery:
    """Upsert every micro-batch of raw bars; what the stream has no column for comes from keys. A batch that is
    run again changes nothing, so each row counts once. Stops when all that has landed is taken in."""

    def merge(batch: DataFrame, _: int) -> None:
        df = stamped(canonical(batch)).drop("file")
        for k in KEYS:
            if k not in df.columns:
                df = df.withColumn(k, F.lit((keys or {}).get(k, "")))
        if not df.isEmpty():
            store.upsert(df, mode)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failed_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append error records to a JSON table; klines.retry_list() of it is what to try again."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream has finished to a Parquet table. Stops when all that has landed is taken in."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling_bars(events: DataFrame, width: str, late: str, symbol: str, ts: str, price: str, volume: str) -> DataFrame:
    """Open, high, low, close and volume per symbol and window of event time; a window is final once the
    watermark, ``late`` behind the newest event, has passed its end."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, F.col(symbol).alias("symbol")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("trades")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def zip_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of zipped CSV files as they land: raw rows with their file; those of files that cannot be read go
    (open_zips() over the stream's files keeps their errors)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_batch).load(path)
    return open_zips(files).where("error is null").drop("error")


def poll(store: KlineStore, function: str, symbols: list[str], kline_types: list[str], intervals: list[str], exchange: str, start: int = 0, options: dict[str, str] | None = None, errors: str | None = None) -> DataFrame:
    """One round of incremental updates of symbols x kline types x intervals, one task each: function
    ("module:name", see PagedBars) gives the bars after each series' newest stored one, or from start on, and all are
    upserted at once. A task that fails loses no other's bars. Returns its record (symbol, kline_type, interval,
    error_message, timestamp), staged, and appends it to the JSON table at errors, whose retry_list() is what to try
    again."""
    spark = store.spark
    marks = store.high_water_mark().where((F.col("exchange") == exchange) & F.col("symbol").isin(symbols))
    known = {(r["symbol"], r["kline_type"], r["interval"]): r["last_ts"] for r in marks.collect()}  # one row per series asked for
    tasks = [{"symbol": s, "kline_type": k, "interval": i, "start": known[s, k, i] + 1 if (s, k, i) in known else start} for s, k, i in product(symbols, kline_types, intervals)]
    spark.dataSource.register(PagedBars)
    got = stage(spark.read.format("paged_bars").options(function=function, tasks=json.dumps(tasks), **(options or {})).load(), "polled")
    new = stamped(canonical(got.where("error is null").drop("error"))).withColumn("exchange", F.lit(exchange))
    if not new.isEmpty():
        store.upsert(new)
    failed = stage(got.where("error is not null").select("symbol", "kline_type", "interval", F.col("error").alias("error_message"), F.current_timestamp().alias("timestamp")), "failed")
    unstage(got)
    if errors and not failed.isEmpty():
        failed.write.mode("append").json(errors)
    return failed
