"""Tables between steps, in a folder that the driver and all executors share: written once, read as often as
needed, and not lost with an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_tables: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a warehouse that is not a machine's own folder on a cluster, and a
    temporary folder, removed at the end, in local mode."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return warehouse + "/stages"
    if _own is None:
        _own = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table and read back; unstage() removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex[:12]}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path.rpartition("/")[0])
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove tables of stage() that nothing reads any more; others are left alone."""
    for df in tables:
        if found := _tables.pop(id(df), None):
            remove(df.sparkSession, found[1])
