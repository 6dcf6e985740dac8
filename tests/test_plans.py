"""What plans read: trades once, bars from the shared folder."""

import importlib.util
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelforge.functions.probit import probit
from panelforge.plans import catalog

SF = "/root/testdata/sf0.001"


def scans(spark, name):
    """How often a query's final plan, and the jobs before it, read lineitem's file."""
    seen = []
    read = type(spark.read).parquet

    def counted(self, *paths, **options):
        seen.extend(p for p in paths if "lineitem" in str(p))
        return read(self, *paths, **options)

    type(spark.read).parquet = counted
    try:
        df = catalog.QUERIES[name](spark, SF)
    finally:
        type(spark.read).parquet = read
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(seen), plan.count("lineitem.parquet"), plan


@pytest.mark.parametrize("name", ["e_divide", "ts_mean", "cs_rank", "m_high_minus_low", "m_fitness_weighted", "flagship_rank_ic"])
def test_trades_are_read_once(spark, name):
    opened, planned, plan = scans(spark, name)
    assert opened == 1 and planned == 0
    assert plan.count("FileScan") <= 12 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_probit_far_out(spark):
    """By the distribution function itself, down to where doubles end."""
    ps = [10.0**-k for k in (1, 3, 5, 8, 11, 12, 15, 30, 100, 300)] + [0.5, 0.3, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(probit(F.col("p"))).collect()]
    for p, z in zip(ps, got, strict=True):
        assert math.isclose(math.erfc(-z / math.sqrt(2)) / 2, p, rel_tol=1e-11)


def test_entry_without_the_optional_part(tmp_path):
    """A part that is absent is left out; a part that is there and broken is an error."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    shutil.copytree(root / "panelforge", tmp_path / "panelforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE)), "False"]
    (tmp_path / "panelforge" / "llm").mkdir()
    (tmp_path / "panelforge" / "llm" / "__init__.py").write_text("")
    (tmp_path / "panelforge" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    assert run().returncode != 0 and importlib.util.find_spec("a_module_that_is_not_there") is None
