import pyarrow as pa
import pytest
from pyarrow import feather

from panelforge.sources.loaders import CsvLoader, FrameLoader, PagedBars, Sources, read_feather


def test_sources_make_one_panel(spark, tmp_path):
    (tmp_path / "a.csv").write_text("open_time,open\n1,2.5\n2,3.5\n")
    csv = CsvLoader(spark, str(tmp_path / "a.csv"), "open_time long, open double")
    frame = FrameLoader(spark.createDataFrame([("x", 1, 9.0)], "symbol string, open_time long, open double"))
    p = Sources().add(csv).add(frame).panel(["open"])
    assert sorted((r["symbol"], r["ts"], r["open"]) for r in p.df.collect()) == [("1", 1, 2.5), ("1", 2, 3.5), ("x", 1, 9.0)]
    with pytest.raises(ValueError):
        FrameLoader(frame.df, "time").dataset()


def test_feather(spark, tmp_path):
    (tmp_path / "s").mkdir()
    feather.write_feather(pa.table({"t": [1, 2], "x": [0.5, None]}), str(tmp_path / "s" / "a.feather"))
    (tmp_path / "s" / "b.feather").write_bytes(b"no feather")
    got = read_feather(spark, str(tmp_path), "t long, x double, y string").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, None), (2, None, None)]


def test_paged_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_pages.py").write_text("def rows(symbol, at, n):\n    return [[t, 1, 1, 1, 1, 1, t + 9, 1, 1, 1, 1, 0] for t in range(0, 50, 10) if t >= at][:n]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_pages.py"))
    spark.dataSource.register(PagedBars)
    df = spark.read.format("paged_bars").option("function", "fake_pages:rows").option("symbols", "A,B").option("limit", "2").load()
    assert sorted((r["symbol"], int(r["open_time"])) for r in df.collect()) == [(s, t) for s in "AB" for t in range(0, 50, 10)]
