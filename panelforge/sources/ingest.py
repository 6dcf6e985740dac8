"""Bars from outside: paged sources with a cursor, zipped or plain CSV files, and made-up panels."""

from __future__ import annotations

import io
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelforge.sources.klines import COLUMNS, INTERVALS, canonical, exists
from panelforge.sources.stages import stage
from panelforge.sources.timeparse import duration_ms

RAW = StructType([StructField(c, StringType()) for c in COLUMNS])
#: Which data types each asset and period has, and the labels of intervals.
_FUTURES = {
    "daily": ("klines", "markPriceKlines", "indexPriceKlines", "premiumIndexKlines", "trades", "aggTrades", "bookDepth", "bookTicker", "metrics", "liquidationSnapshot"),
    "monthly": ("klines", "markPriceKlines", "indexPriceKlines", "premiumIndexKlines", "trades", "aggTrades", "fundingRate", "bookTicker"),
}
MARKETS = {("spot", ""): ("klines", "trades", "aggTrades"), ("option", "daily"): ("BVOLIndex", "EOHSummary")} | {(kind, period): types for kind in ("um", "cm") for period, types in _FUTURES.items()}


class BadParameters(ValueError):
    """A combination of market, data type and interval that does not exist."""


class SourceError(RuntimeError):
    """A source that still fails after its retries."""


def check_parameters(asset: str, period: str, data_type: str, interval: str | None = None) -> None:
    """Raise BadParameters unless the combination exists; intervals of a second are for spot alone."""
    kinds = MARKETS.get((asset, "" if asset == "spot" else period))
    if kinds is None or (asset == "spot" and period not in ("daily", "monthly")):
        raise BadParameters(f"no {period} data of {asset!r}")
    if data_type not in kinds:
        raise BadParameters(f"no {data_type!r} of {asset} {period}; there are {', '.join(kinds)}")
    if interval is not None and interval not in INTERVALS:
        raise BadParameters(f"unknown interval {interval!r}")
    if interval == "1s" and asset != "spot":
        raise BadParameters("1s is for spot only")


def prefix(asset: str, period: str, data_type: str, symbol: str, interval: str | None = None) -> str:
    """The folder of one series."""
    check_parameters(asset, period, data_type, interval)
    parts = ["data", *(["spot"] if asset == "spot" else ["option"] if asset == "option" else ["futures", asset]), period, data_type, symbol.upper()]
    return "/".join([*parts, interval] if interval else parts) + "/"


def with_retries(call: Callable, retries: int = 2, wait: float = 5.0, sleep: Callable = time.sleep):
    """call(), again after wait, wait squared ... seconds."""
    for k in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if k == retries:
                raise SourceError(str(e)) from e
            sleep(wait ** (k + 1))


def pages(fetch: Callable[[int, int], list[list]], start: int, end: int | None = None, limit: int = 1000, total: int | None = None, retries: int = 2, sleep: Callable = time.sleep, throttle: float = 0.0) -> Iterator[list[list]]:
    """Pages of rows from fetch(from_ms, limit), each from the close time of the last row plus one, until a
    page is short, the end is passed, or ``total`` rows have come (exactly so many, no more). throttle: seconds
    between pages."""
    cursor, seen, first = start, 0, True
    while (end is None or cursor <= end) and (total is None or seen < total):
        at = cursor
        if throttle and not first:
            sleep(throttle)
        first = False
        rows = with_retries(lambda: fetch(at, limit), retries, sleep=sleep)
        full = len(rows) >= limit
        rows = [r for r in rows if end is None or int(r[0]) <= end]
        if total is not None:
            rows = rows[: total - seen]
        if rows:
            yield rows
            seen += len(rows)
            cursor = max(int(rows[-1][6]), at) + 1
        if not full or not rows:
            return


def from_rows(spark: SparkSession, rows: list[list]) -> DataFrame:
    """Canonical bars of rows as a paged source gives them."""
    return canonical(spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows], RAW))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical bars of CSV files, with or without a header line, in any number."""
    return canonical(spark.read.schema(RAW).option("header", "false").option("mode", "PERMISSIVE").csv(path))


_OPENED = StructType([*RAW.fields, StructField("file", StringType()), StructField("error", StringType())])


def _columns(data: bytes) -> list[pa.Array]:
    """The fields of CSV lines as columns of text; what a line has too few of is null, too many are dropped."""
    from pyarrow import csv

    width = data.partition(b"\n")[0].count(b",") + 1
    names = [str(k) for k in range(max(width, len(COLUMNS)))]
    try:
        if not data.strip():
            raise pa.ArrowInvalid("no lines")
        t = csv.read_csv(io.BytesIO(data), csv.ReadOptions(column_names=names[:width]), convert_options=csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=True))
        return [t.column(c).combine_chunks() if c in t.column_names else pa.nulls(t.num_rows, pa.string()) for c in names[: len(COLUMNS)]]
    except pa.ArrowInvalid:  # lines of different widths
        rows = [(line.split(",") + [None] * len(COLUMNS))[: len(COLUMNS)] for line in data.decode().splitlines() if line]
        return [pa.array([r[k] for r in rows], pa.string()) for k in range(len(COLUMNS))]


def unzipped(content: bytes, path: str) -> pa.RecordBatch:
    """The rows of a zipped CSV file's one member, as text, with their file; one row with the error if it cannot be
    read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if n.endswith(".csv")), None)
            if name is None:
                raise ValueError("no CSV member")
            data = z.read(name)
        if not data[:1].isdigit():
            data = data.partition(b"\n")[2]  # a header: columns go by place
        cols = _columns(data)
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*cols, pa.array([path] * n, pa.string()), pa.nulls(n, pa.string())], schema=_ARROW)
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, OSError) as e:
        return pa.RecordBatch.from_pylist([{"file": path, "error": f"{type(e).__name__}: {e}"}], schema=_ARROW)


_ARROW = pa.schema([(f.name, pa.string()) for f in _OPENED])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            yield unzipped(content.as_py(), path.as_py())


def open_zips(files: DataFrame, start_date: str | None = None) -> DataFrame:
    """Raw rows of zipped CSV files (path, content), as a table or a stream, with columns file and error: a file that
    cannot be read gives one row with its error. Files dated before start_date (yyyy-MM-dd in the name) are not
    opened."""
    day = F.regexp_extract("path", r"(\d{4}-\d\d-\d\d)\.zip$", 1)
    if start_date:
        files = files.where((day == "") | (day >= start_date))
    return files.select("path", "content").mapInArrow(_unpack, _OPENED)


def read_zip(spark: SparkSession, path: str, start_date: str | None = None) -> DataFrame:
    """Canonical bars of zipped CSV files, one member each, with a column ``file``. Files dated before start_date
    are not opened; files that cannot be read give no rows: bad_zips() lists them."""
    return canonical(open_zips(_zips(spark, path), start_date).where("error is null").drop("error"))


def bad_zips(spark: SparkSession, path: str, start_date: str | None = None) -> DataFrame:
    """(file, error) of the zipped files that read_zip() leaves out."""
    return open_zips(_zips(spark, path), start_date).where("error is not null").select("file", "error")


def _zips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)


def land(available: DataFrame, folder: str, function: str) -> DataFrame:
    """Fetch the available files (path) that are not in the folder's manifest yet, by function ("module:name", called
    with the path on the executors, returns the zip's bytes), and append their bars to folder/bars and their names to
    folder/manifest. Running it again fetches nothing twice. Returns (file, error) of those that failed, staged: they
    are tried again next time."""
    spark = available.sparkSession
    known = StructType([StructField("path", StringType())])
    manifest = spark.read.schema(known).parquet(f"{folder}/manifest") if exists(spark, f"{folder}/manifest") else spark.createDataFrame([], known)
    missing = missing_files(available.select("path").distinct(), manifest)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import importlib

        module, name = function.split(":")
        call = getattr(importlib.import_module(module), name)
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    yield unzipped(with_retries(lambda: call(path)), path)  # noqa: B023
                except SourceError as e:
                    yield pa.RecordBatch.from_pylist([{"file": path, "error": f"SourceError: {e}"}], schema=_ARROW)

    tasks = max(1, min(missing.count(), spark.sparkContext.defaultParallelism * 4))
    opened = stage(missing.repartition(tasks).mapInArrow(fetch, _OPENED), "fetched")
    good = canonical(opened.where("error is null").drop("error"))
    good.write.mode("append").parquet(f"{folder}/bars")
    failed = opened.where("error is not null").select("file", "error")
    missing.join(failed, F.col("path") == F.col("file"), "left_anti").write.mode("append").parquet(f"{folder}/manifest")
    return failed


def file_symbol(path: F.Column) -> F.Column:
    """SYMBOL of .../SYMBOL-INTERVAL-yyyy-MM-dd.zip."""
    return F.regexp_extract(path, r"([^/]+?)-[^/]*$", 1)


def missing_files(available: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """The available files that the manifest does not list yet."""
    return available.join(manifest.select(key).distinct(), key, "left_anti")


def listed_keys(xml: str, symbols: list[str] | None = None) -> tuple[list[str], str | None]:
    """The .zip keys of one listing page, and the marker of the next page (None: the last page). The marker
    moves on whether or not a key was wanted."""
    root = ElementTree.fromstring(xml)
    keys = [e.text or "" for e in root.iter() if e.tag.rpartition("}")[2] == "Key"]
    more = any(e.tag.rpartition("}")[2] == "IsTruncated" and (e.text or "").strip().lower() == "true" for e in root.iter())
    wanted = [k for k in keys if k.endswith(".zip") and (symbols is None or any(s in k for s in symbols))]
    return wanted, keys[-1] if more and keys else None


def made_up_bars(spark: SparkSession, symbols: int = 3, bars: int = 10_000, seed: int = 42, step: str = "1h", start: int = 1_672_531_200_000) -> DataFrame:
    """Random-walk bars, ``step`` apart, the same for the same seed: open a walk, close near it, high and low around both,
    lognormal volume, taker share between 0.35 and 0.75."""
    import numpy as np
    import pandas as pd

    step_ms = duration_ms(step)

    def make(batches):
        for pdf in batches:
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                o = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, bars)))
                c = o * (1 + rng.normal(0, 0.005, bars))
                v, share = rng.lognormal(10, 1, bars), rng.uniform(0.35, 0.75, bars)
                t = start + step_ms * np.arange(bars)
                yield pd.DataFrame({
                    "symbol": f"SYM{k}", "open_time": t, "open": o, "high": np.maximum(o, c) * (1 + abs(rng.normal(0, 0.002, bars))), "low": np.minimum(o, c) * (1 - abs(rng.normal(0, 0.002, bars))), "close": c,
                    "volume": v, "close_time": t + step_ms - 1, "quote_volume": v * c, "trades": rng.integers(100, 10_000, bars), "taker_buy_base": v * share, "taker_buy_quote": v * share * c,
                })

    schema = "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double"
    return spark.range(symbols).repartition(min(symbols, 200)).mapInPandas(make, schema)
