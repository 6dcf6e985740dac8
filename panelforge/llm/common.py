"""Shared plumbing of the training-data operators: shared-folder tables, Arrow access, sizes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Tables that staged() wrote, with their folders.
_tables: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where it is unset, a warehouse that is not a
    machine's own folder on a cluster, and a temporary folder in local mode."""
    global _own_dir
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return warehouse + "/llm-stages"
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="panelforge-")
    return _own_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives
    the loss of executors, and keeps nothing on executor disks. release() removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path.rpartition("/")[0])
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame | None) -> None:
    """Remove tables that staged() wrote and nothing reads any more; others are left alone."""
    for df in tables:
        if df is not None and (found := _tables.pop(id(df), None)):
            _remove(df.sparkSession, found[1])


def release_all(spark: SparkSession) -> None:
    """Remove all tables that staged() wrote and are still there: once no result of this session is read."""
    for df, path in list(_tables.values()):
        if df.sparkSession is spark:
            del _tables[id(df)]
            _remove(spark, path)


def join_grouped(rows: DataFrame, grouped: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with the result of a groupBy(keys), on keys. The grouped side lies by these keys already, and
    a join that makes use of it cannot be split; so both sides are dealt out anew, by values in which the keys
    are hidden, and adaptive execution can split what a hot key has of rows."""
    def hidden(k: str, df: DataFrame) -> Column:
        return F.concat(F.lit("="), F.col(k)) if dict(df.dtypes)[k] == "string" else F.bitwise_not(F.col(k))

    left = rows.withColumns({f"__{k}": hidden(k, rows) for k in keys})
    right = grouped.withColumns({f"__{k}": hidden(k, grouped) for k in keys}).drop(*keys)
    return left.join(right, [f"__{k}" for k in keys], how).drop(*[f"__{k}" for k in keys])


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of a batch with nulls as empty strings."""
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold at most about ``limit`` bytes; a longer text is alone."""
    import numpy as np

    arr = batch.column(batch.schema.get_field_index(name))
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    """The texts of a batch one after the other, nulls as empty ones, about a megabyte of them at a time."""
    arr = text_array(batch, name)
    for i, j in slices(batch, name):
        yield from arr.slice(i, j - i).to_pylist()


def trim() -> None:
    """Give what this Python worker has freed back to the system: it stays for the tasks of later stages, beside
    the executor's JVM. Does nothing where the C library cannot."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
