"""The bar store: one Parquet table, partitioned by exchange, kline type, interval and bucket of symbols."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from panelforge.sources.stages import stage, unstage

# Column names and labels of the data's public format.
COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
RENAMED = {"count": "trades", "taker_buy_volume": "taker_buy_base", "taker_buy_quote_volume": "taker_buy_quote"}
KEYS = ("exchange", "symbol", "kline_type", "interval")
KLINE_TYPES = ("spot", "swap", "mark", "index")
INTERVALS = ("1s", "1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1mo")
_LONGS = ("open_time", "close_time", "trades", "ignore")
_AUDIT = ("created_at", "updated_at")

SCHEMA = StructType([StructField(c, LongType() if c in _LONGS else DoubleType()) for c in COLUMNS] + [StructField("timestamp", LongType()), StructField("created_at", TimestampType())] + [StructField(k, StringType()) for k in KEYS])


def canonical(df: DataFrame) -> DataFrame:
    """Either flavour's columns under one name and type. What is no number becomes NULL, or 0 for trades and
    ignore; rows without an open time, such as headers among the data, go."""
    for old, new in RENAMED.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    cols: list[Column] = []
    for c in df.columns:
        if c not in COLUMNS:
            cols.append(F.col(c))
            continue
        number = F.col(c).try_cast("double")
        number = F.when(~F.isnan(number), number)
        if c in _LONGS:
            whole = F.coalesce(F.col(c).try_cast("long"), number.try_cast("long"))
            cols.append((F.coalesce(whole, F.lit(0)) if c in ("trades", "ignore") else whole).cast("long").alias(c))
        else:
            cols.append(number.alias(c))
    return df.select(*cols).where("open_time is not null")


def stamped(df: DataFrame) -> DataFrame:
    """With timestamp (the open time) and created_at (now)."""
    return df.withColumn("timestamp", F.col("open_time").cast("long")).withColumn("created_at", F.current_timestamp())


def in_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows with start <= timestamp <= end; None is open."""
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    return df if end is None else df.where(F.col("timestamp") <= end)


def merged(old: DataFrame, new: DataFrame, mode: str = "latest", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Old and new rows as one. "exact": rows equal in all of new's columns but the audit ones are kept once,
    the oldest. "latest": one row per keys and timestamp, the newest."""
    if mode not in ("exact", "latest"):
        raise ValueError(f"unknown mode {mode!r}")
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = sorted(c for c in both.columns if c not in _AUDIT and c != "__new")
    if mode == "exact":
        by, order = [c for c in new.columns if c not in _AUDIT], ["__new", *([F.col("created_at").asc_nulls_last()] if "created_at" in both.columns else [])]
    else:
        by, order = [c for c in keys if c in both.columns] + ["timestamp"], [F.desc("__new"), *([F.col("created_at").desc_nulls_last()] if "created_at" in both.columns else [])]
    w = Window.partitionBy(*by).orderBy(*order, *[c for c in rest if c not in by])
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def high_water_mark(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The newest timestamp of each key."""
    return df.groupBy(*keys).agg(F.max("timestamp").alias("last_ts"))


def newer_than(new: DataFrame, mark: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of new past their key's mark; all rows of keys without one."""
    out = new.join(mark.select(*keys, "last_ts"), list(keys), "left")
    return out.where(F.col("last_ts").isNull() | (F.col("timestamp") > F.col("last_ts"))).drop("last_ts")


def trading_pairs(df: DataFrame, quote: str, symbol: str = "symbol") -> DataFrame:
    """Distinct symbols that end in the quote currency, sorted."""
    return df.select(symbol).distinct().where(F.col(symbol).endswith(quote)).orderBy(symbol)


def active_symbols(listing: DataFrame, quote: str | None = None, status: str = "TRADING") -> DataFrame:
    """(symbol), distinct, of a listing (symbol, status): those with the status, and of one quote currency."""
    out = listing.where(F.col("status") == status)
    return (out if quote is None else out.where(F.col("symbol").endswith(quote))).select("symbol").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def retry_list(errors: DataFrame, keys: tuple[str, ...] = ("symbol", "interval", "kline_type")) -> DataFrame:
    """The failed tasks of an error log, each once."""
    return errors.select(*keys).dropDuplicates()


#: Folders that the symbols of an exchange, kline type and interval are dealt to, by their CRC-32: there are never more files
#: than data, however many series there are. A store's reads depend on it: it is fixed.
BUCKETS = 256
#: Folders of the store, outermost first.
FOLDERS = ("exchange", "kline_type", "interval", "symbol_bucket")
#: Up to so many touched folders are looked up by name, which prunes partitions; more by a join.
MAX_NAMED_FOLDERS = 10_000
_SERIES_PATH = re.compile("/".join(f"{k}=(.*)" for k in KEYS))


def _bucket(symbol: Column) -> Column:
    return (F.crc32(symbol.cast("binary")) % BUCKETS).cast("int")


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal in all keys, missing ones being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"__{k}"])
    return out


@dataclass(frozen=True)
class KlineStore:
    """A store at a path that all executors see. schema: its columns, KEYS among them; it is stated, so that
    no read has to open every file for it. A series lies with others in the files of its bucket, sorted by
    symbol and time: a read of some symbols opens their buckets and skips the row groups of others."""

    spark: SparkSession
    path: str
    schema: StructType = SCHEMA

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def _stored(self) -> DataFrame:
        """All rows with the bucket they lie in; an absent store is empty."""
        schema = StructType([*self.schema.fields, StructField("symbol_bucket", IntegerType())])
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)

    def read(self, symbols: list[str] | None = None, start: int | None = None, end: int | None = None, **keys: str) -> DataFrame:
        """Bars of the keys given, both ends of the time range included; an absent store is empty. Keys prune
        partitions, symbols and times are pushed down to the files."""
        unknown = keys.keys() - set(KEYS)
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        df = in_range(self._stored(), start, end)
        for k, v in keys.items():
            df = df.where(F.col(k) == v)
        if symbols is not None:
            df = df.where(F.col("symbol").isin(symbols)) if symbols else df.where("false")
        for some in ([keys["symbol"]] if "symbol" in keys else None, symbols):
            if some:
                buckets = {zlib.crc32(str(s).encode()) % BUCKETS for s in some if s is not None}
                # a store of the former layout, one folder per series, has no buckets and is read all the same
                df = df.where(F.col("symbol_bucket").isin(sorted(buckets)) | F.col("symbol_bucket").isNull())
        return df.drop("symbol_bucket")

    def series(self, path: str) -> DataFrame:
        """Bars of the series of a path of catalog()."""
        found = _SERIES_PATH.fullmatch(path.removeprefix(self.path.rstrip("/")).lstrip("/"))
        if not found:
            raise ValueError(f"no series of this store: {path!r}")
        return self.read(**dict(zip(KEYS, found.groups(), strict=True)))

    def _aligned(self, df: DataFrame) -> DataFrame:
        extra = set(df.columns) - set(self.schema.names)
        if extra:
            raise ValueError(f"columns {sorted(extra)} are not in the store's schema")
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _replace(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put merge(stored rows, new) in the place of the folders that new has rows of. Both have a column __other, set
        where a stored row is of a series that new has none of. The rows are written aside before they replace what
        they were read from."""
        if self.exists() and _former(self.spark, self.path):
            raise RuntimeError(f"{self.path} has a folder for each series: read() it and write() it to another path")
        new = new.withColumn("symbol_bucket", _bucket(F.col("symbol")))
        folders = new.select(*FOLDERS).distinct()
        named = folders.limit(MAX_NAMED_FOLDERS + 1).collect()
        old = self._stored()
        if len(named) <= MAX_NAMED_FOLDERS:
            for k in FOLDERS:
                values = {r[k] for r in named}
                within = F.col(k).isin(sorted(values - {None}))
                old = old.where(within | F.col(k).isNull() if None in values else within)
        lost = folders.select(*[F.col(k).alias(f"__{k}") for k in FOLDERS])
        old = old.join(lost, _same(old, lost, FOLDERS), "left_semi")
        series = new.select(*[F.col(k).alias(f"__{k}") for k in KEYS]).distinct().withColumn("__touched", F.lit(True))
        old = old.join(series, _same(old, series, KEYS), "left").withColumn("__other", F.when(F.col("__touched").isNull(), F.monotonically_increasing_id()))
        old = old.drop("__touched", *[f"__{k}" for k in KEYS])
        aside = stage(merge(old, new.withColumn("__other", F.lit(None).cast("long"))).drop("__other"), "merging")
        try:
            # a bucket is a task's, or several tasks' if it is large
            rows = aside.hint("rebalance", *[F.col(k) for k in FOLDERS]).sortWithinPartitions(*FOLDERS, "symbol", "timestamp")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(self.path)
        finally:
            unstage(aside)

    def write(self, df: DataFrame) -> None:
        """Replace the series that df has rows of; the others stay."""
        self._replace(self._aligned(df), lambda old, new: old.where("__other is not null").unionByName(new))

    def upsert(self, new: DataFrame, mode: str = "latest") -> None:
        """Merge new rows into their series; only the folders of those are read and written, and other series in
        them stay as they are. Running it again changes nothing."""
        self._replace(self._aligned(new), lambda old, new: merged(old, new, mode, (*KEYS, "__other")))

    def high_water_mark(self) -> DataFrame:
        return high_water_mark(self.read())

    def catalog(self) -> DataFrame:
        """(exchange, symbol, kline_type, interval, path) of every stored series. path names the series within the
        store, and series() reads it; its rows lie in the files of its bucket."""
        part = F.concat_ws("/", F.lit(self.path.rstrip("/")), *[F.concat(F.lit(f"{k}="), F.col(k)) for k in KEYS])
        return self.read().select(*KEYS).distinct().withColumn("path", part)


def _former(spark: SparkSession, path: str) -> bool:
    """Whether the store at a path has a folder for each series."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/exchange=*/symbol=*")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))
