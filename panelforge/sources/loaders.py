"""Where panels come from: loaders of one source each, and a handler that unites several.

A loader is anything with dataset(); CsvLoader and FrameLoader are two, PagedBars makes a Spark data
source of any function that returns pages of rows."""

from __future__ import annotations

import importlib
import io
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from panelforge.plans.panel import Panel, union_sources
from panelforge.sources.ingest import RAW, SourceError, pages, with_retries
from panelforge.sources.klines import exists


class Loader(Protocol):
    def dataset(self) -> DataFrame:
        """The source as a DataFrame; made when first asked for."""


class CsvLoader:
    """CSV files with a header that names the time column. schema: their columns in order."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, ts: str = "open_time"):
        self.spark, self.path, self.schema, self.ts = spark, path, schema, ts

    def dataset(self) -> DataFrame:
        df = self.spark.read.schema(self.schema).option("header", "true").csv(self.path)
        return _checked(df, self.ts)


class FrameLoader:
    """A DataFrame that is there already."""

    def __init__(self, df: DataFrame, ts: str = "open_time"):
        self.df, self.ts = df, ts

    def dataset(self) -> DataFrame:
        return _checked(self.df, self.ts)


def _checked(df: DataFrame, ts: str) -> DataFrame:
    if ts not in df.columns:
        raise ValueError(f"no column {ts!r} in {df.columns}")
    return df


class Sources:
    """Loaders united to one panel; a source without the tag column gets its number as tag."""

    def __init__(self, tag: str = "symbol", ts: str = "open_time"):
        self.tag, self.ts, self.loaders = tag, ts, []

    def add(self, loader: Loader) -> Sources:
        self.loaders.append(loader)
        return self

    def panel(self, fields: list[str]) -> Panel:
        df = union_sources([x.dataset() for x in self.loaders], self.tag)
        return Panel(df.select(df[self.tag].alias("symbol"), df[self.ts].alias("ts"), *fields), tuple(fields))


def read_feather(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Feather files below path, read on the executors, columns by name; a file that is corrupt gives no rows, and
    neither does a path that does not exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.feather").load(path)
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import feather
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(out)
        for b in batches:
            for content in b.column(0).to_pylist():
                try:
                    t = feather.read_table(io.BytesIO(content))
                except (pa.ArrowInvalid, OSError):
                    continue
                cols = [t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in want]
                yield from pa.Table.from_arrays(cols, schema=want).to_batches()

    return files.select("content").mapInArrow(read, out)


class PagedBars(DataSource):
    """Raw bars of paged functions, one partition per task. Options: function ("module:name", on the executors), end,
    limit, throttle, and either symbols (comma-joined; function(symbol, from_ms, limit)) and start, or tasks (a JSON
    list of objects symbol, kline_type, interval, start; function(symbol, kline_type, interval, from_ms, limit)).
    A task that fails gives, after what it has had, one row with the error and no bar."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> StructType:
        return StructType([*RAW.fields, *[StructField(c, StringType()) for c in ("symbol", "kline_type", "interval", "error")]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Task(InputPartition):
    def __init__(self, keys: tuple, start: int):
        self.keys, self.start = keys, start


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if "tasks" in self.options:
            return [_Task((t["symbol"], t["kline_type"], t["interval"]), int(t.get("start") or 0)) for t in json.loads(self.options["tasks"])]
        return [_Task((s,), int(self.options.get("start", 0))) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: _Task) -> Iterator[tuple]:
        module, name = self.options["function"].split(":")
        call = getattr(importlib.import_module(module), name)
        end, keys = self.options.get("end"), (*partition.keys, None, None)[:3]
        retries, wait = int(self.options.get("retries", 2)), float(self.options.get("wait", 5))
        try:
            for page in pages(lambda at, n: with_retries(lambda: call(*partition.keys, at, n), retries, wait), partition.start, int(end) if end else None, int(self.options.get("limit", 1000)), retries=0, throttle=float(self.options.get("throttle", 0))):
                for r in page:
                    yield (*[None if v is None else str(v) for v in r[:12]], *keys, None)
        except SourceError as e:
            yield (*[None] * 12, *keys, str(e))
