import io
import json
import zipfile
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from panelforge.sources import ingest, klines, quality
from panelforge.sources.klines import KlineStore
from panelforge.sources.timeparse import duration_ms, ms_to_date, parse_time, parse_time_column
from panelforge.streaming import updates

KEYS = {"exchange": "x", "kline_type": "swap", "interval": "1h"}


def raw(t, close=2.0):
    return [t, 1, 3, 0.5, close, 10, t + 99, 20, 5, 1, 2, 0]


def bars(spark, rows, symbol="AUSDT"):
    df = klines.stamped(ingest.from_rows(spark, rows)).withColumn("symbol", F.lit(symbol))
    for k, v in KEYS.items():
        df = df.withColumn(k, F.lit(v))
    return df


def test_store_upserts_are_idempotent(spark, tmp_path):
    store = KlineStore(spark, str(tmp_path / "bars"))
    assert store.read().count() == 0
    store.upsert(bars(spark, [raw(0), raw(100), raw(200)]))
    store.upsert(bars(spark, [raw(0)], "BUSDT"))
    store.upsert(bars(spark, [raw(200, 9.0), raw(300)]))
    store.upsert(bars(spark, [raw(200, 9.0), raw(300)]))
    got = {(r["symbol"], r["timestamp"]): r["close"] for r in store.read().collect()}
    assert got == {("AUSDT", 0): 2.0, ("AUSDT", 100): 2.0, ("AUSDT", 200): 9.0, ("AUSDT", 300): 2.0, ("BUSDT", 0): 2.0}
    assert {r["symbol"]: r["last_ts"] for r in store.high_water_mark().collect()} == {"AUSDT": 300, "BUSDT": 0}
    assert store.read(["AUSDT"], 100, 200).count() == 2 and store.read([]).count() == 0
    assert store.read(symbol="BUSDT").count() == 1 and store.catalog().count() == 2
    plan = store.read(["AUSDT"], 100, 200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(timestamp,100)" in plan
    with pytest.raises(ValueError):
        store.read(colour="red")


def test_store_of_many_series_has_few_files(spark, tmp_path):
    """The files do not grow with the series; a revision, or a rewrite, of some leaves the others in their folders alone."""
    store = KlineStore(spark, str(tmp_path / "bars"))
    base = klines.stamped(ingest.from_rows(spark, [raw(0), raw(100)]))
    many = base.crossJoin(spark.range(2000).select(F.concat(F.lit("S"), "id").alias("symbol"))).withColumns({k: F.lit(v) for k, v in KEYS.items()})
    store.upsert(many)
    assert len(list((tmp_path / "bars").rglob("*.parquet"))) <= klines.BUCKETS
    assert store.read().count() == 4000 and store.catalog().count() == 2000 == store.high_water_mark().count()
    assert sorted((r["symbol"], r["timestamp"]) for r in store.read(["S7", "S1999"], 100).collect()) == [("S1999", 100), ("S7", 100)]
    one = store.catalog().where("symbol = 'S7'").first()["path"]
    assert one.endswith("/exchange=x/symbol=S7/kline_type=swap/interval=1h") and store.series(one).count() == 2
    with pytest.raises(ValueError):
        store.series("elsewhere")
    # revisions that are kept stay when another series of the bucket is written
    bucket = {s for s in (f"S{k}" for k in range(2000)) if klines.zlib.crc32(s.encode()) % klines.BUCKETS == klines.zlib.crc32(b"S7") % klines.BUCKETS}
    other = max(bucket - {"S7"})
    store.upsert(bars(spark, [raw(0, 5.0)], other), "exact")
    for _ in range(2):
        store.upsert(bars(spark, [raw(0, 9.0), raw(200)], "S7"))
    assert sorted(r["close"] for r in store.read([other], 0, 0).collect()) == [2.0, 5.0]
    assert sorted((r["timestamp"], r["close"]) for r in store.read(["S7"]).collect()) == [(0, 9.0), (100, 2.0), (200, 2.0)]
    store.write(bars(spark, [raw(300)], "S7"))
    assert [r["timestamp"] for r in store.read(symbol="S7").collect()] == [300] and store.read().count() == 4000


def test_store_of_odd_series(spark, tmp_path):
    """Missing and empty symbols and such with slashes are series like others; a former store is read, not mixed."""
    store = KlineStore(spark, str(tmp_path / "bars"))
    for _ in range(2):
        for s in (None, "", "A/B=1"):
            store.upsert(bars(spark, [raw(0), raw(100)], s).withColumn("symbol", F.lit(s).cast("string")))
    assert sorted((str(r["symbol"]), r["timestamp"]) for r in store.read().collect()) == [("", 0), ("", 100), ("A/B=1", 0), ("A/B=1", 100), ("None", 0), ("None", 100)]
    path = store.catalog().where("symbol = 'A/B=1'").first()["path"]
    assert store.series(path).count() == 2 == store.read([""]).count()
    former = KlineStore(spark, str(tmp_path / "former"))
    bars(spark, [raw(0)]).write.partitionBy(*klines.KEYS).parquet(former.path)
    assert former.read(["AUSDT"]).count() == 1 == former.read(symbol="AUSDT").count()
    with pytest.raises(RuntimeError):
        former.upsert(bars(spark, [raw(0)]))
    moved = KlineStore(spark, str(tmp_path / "moved"))
    moved.write(former.read())
    assert moved.read(["AUSDT"]).count() == 1


def test_exact_mode_keeps_revisions(spark):
    old, new = bars(spark, [raw(0), raw(100)]), bars(spark, [raw(0), raw(100, 7.0)])
    assert klines.merged(old, new, "exact").count() == 3
    assert klines.merged(old, new, "latest").count() == 2
    assert klines.newer_than(new, klines.high_water_mark(old.where("timestamp = 0"))).count() == 1


def test_canonical(spark):
    df = spark.createDataFrame([("open_time", "open", "count"), ("5", "x", "7"), ("6", "1.5", None)], "open_time string, open string, count string")
    assert [tuple(r) for r in klines.canonical(df).orderBy("open_time").collect()] == [(5, None, 7), (6, 1.5, 0)]


def test_times(spark):
    day = 1704153600000
    assert [parse_time(v) for v in (None, "2024-01-02", "20240102", "2024-01-02 00:00:00", "  20240102   000000", "20240102000000", "2024-01-02T00:00:00", day, day / 1000, datetime(2024, 1, 2), datetime(2024, 1, 2, 2, tzinfo=timezone(timedelta(hours=2))))] == [None] + [day] * 10
    assert parse_time(946684800000) == 946684800000000 and parse_time(946684800000, "ms") == 946684800000
    with pytest.raises(ValueError):
        parse_time("soon")
    with pytest.raises(TypeError):
        parse_time([1])
    rows = [("2024-01-02",), ("20240102",), ("2024-01-02 00:00:01",), ("20240102 000001",), ("20240102000001",), ("2024-01-02T00:00:01",), ("soon",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(parse_time_column(F.col("t"))).collect()]
    assert got == [day, day] + [day + 1000] * 4 + [None, None]
    assert spark.range(1).select(ms_to_date(F.lit(day + 5))).first()[0] == "2024-01-02"


def test_pages_stop_where_they_should():
    have = [raw(t) for t in range(0, 1000, 100)]
    calls = []

    def fetch(start, limit):
        calls.append(start)
        if len(calls) == 1:
            raise OSError("once")
        return [r for r in have if r[0] >= start][:limit]

    waits = []
    assert [len(p) for p in ingest.pages(fetch, 0, limit=4, sleep=waits.append)] == [4, 4, 2] and waits == [5.0]
    calls.append(0)
    assert sum(len(p) for p in ingest.pages(fetch, 0, end=450, limit=3)) == 5
    assert sum(len(p) for p in ingest.pages(fetch, 0, limit=3, total=7)) == 7

    waits.clear()
    assert sum(len(p) for p in ingest.pages(lambda start, limit: [r for r in have if r[0] >= start][:limit], 0, limit=4, sleep=waits.append, throttle=0.2)) == 10 and waits == [0.2, 0.2]

    def broken(start, limit):
        raise OSError("always")

    with pytest.raises(ingest.SourceError):
        list(ingest.pages(broken, 0, retries=1, sleep=lambda s: None))


def test_parameters():
    assert ingest.prefix("um", "daily", "klines", "btcusdt", "1h") == "data/futures/um/daily/klines/BTCUSDT/1h/"
    for bad in (("um", "daily", "klines", "1s"), ("um", "hourly", "klines", "1h"), ("spot", "daily", "fundingRate", None), ("um", "daily", "klines", "7m")):
        with pytest.raises(ingest.BadParameters):
            ingest.check_parameters(*bad)
    assert ingest.listed_keys("<L><Key>a/A-1h.zip</Key><Key>a/B.txt</Key><IsTruncated>true</IsTruncated></L>", ["Z"]) == ([], "a/B.txt")
    assert ingest.listed_keys('<L xmlns="x"><Key>a/A&amp;B-1h.zip</Key><IsTruncated> False</IsTruncated></L>') == (["a/A&B-1h.zip"], None)


def test_durations_and_active_symbols(spark):
    assert [duration_ms(x) for x in ("1h", "15m", "2 D", "w", "500ms")] == [3_600_000, 900_000, 172_800_000, 604_800_000, 500]
    for bad in ("1mo", "", "0h", "h1", "1y"):
        with pytest.raises(ValueError):
            duration_ms(bad)
    listing = spark.createDataFrame([("AUSDT", "TRADING"), ("BUSDT", "BREAK"), ("CBTC", "TRADING"), ("AUSDT", "TRADING"), (None, None)], "symbol string, status string")
    assert sorted(r[0] for r in klines.active_symbols(listing).collect()) == ["AUSDT", "CBTC"]
    assert [r[0] for r in klines.active_symbols(listing, "USDT").collect()] == ["AUSDT"]


def test_files(spark, tmp_path):
    line = ",".join(map(str, raw(100)))
    (tmp_path / "a.csv").write_text(",".join(klines.COLUMNS) + "\n" + line + "\n")
    (tmp_path / "b.csv").write_text(line + "\n")
    assert ingest.read_csv(spark, str(tmp_path / "*.csv")).count() == 2
    for day in ("2024-01-01", "2024-01-02"):
        with zipfile.ZipFile(tmp_path / f"AUSDT-1h-{day}.zip", "w") as z:
            z.writestr("x.csv", "open_time,open\n" + line + "\n")
    (tmp_path / "BUSDT-1h-2024-01-02.zip").write_bytes(b"no zip")
    good = (tmp_path / "AUSDT-1h-2024-01-01.zip").read_bytes()
    long = io.BytesIO()
    with zipfile.ZipFile(long, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", (line + "\n") * 500)
    for name, data in {"cut": good[:-30], "deflate": long.getvalue()[:60] + bytes(40) + long.getvalue()[100:]}.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "nothing.zip", "w") as z:
        z.writestr("x.txt", "no table")
    with zipfile.ZipFile(tmp_path / "ragged.zip", "w") as z:
        z.writestr("x.csv", line + "\n" + line + ",1,2\n")
    bad = {r["file"].rpartition("/")[2]: r["error"] for r in ingest.bad_zips(spark, str(tmp_path)).collect()}
    assert set(bad) == {"BUSDT-1h-2024-01-02.zip", "cut.zip", "deflate.zip", "nothing.zip"} and all(bad.values())
    df = ingest.read_zip(spark, str(tmp_path))
    assert df.where("file LIKE '%ragged%'").count() == 2
    df = df.where("file NOT LIKE '%ragged%'")
    assert df.count() == 2 and {r[0] for r in df.select(ingest.file_symbol(F.col("file"))).collect()} == {"AUSDT"}
    assert ingest.read_zip(spark, str(tmp_path), "2024-01-02").where("file LIKE '%AUSDT%'").count() == 1
    one = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r["path"] for r in ingest.missing_files(one, one.where("path = 'a'")).collect()] == ["b"]


def test_landing(spark, tmp_path):
    """Files are fetched once, failed ones again."""
    (tmp_path / "remote").mkdir()
    for name in ("A-1h-2024-01-01.zip", "B-1h-2024-01-01.zip"):
        with zipfile.ZipFile(tmp_path / "remote" / name, "w") as z:
            z.writestr("x.csv", ",".join(map(str, raw(100))) + "\n")
    (tmp_path / "landing_source.py").write_text("def get(path):\n    open(path + '.log', 'a').write('x')\n    return open(path, 'rb').read()\n")
    spark.sparkContext.addPyFile(str(tmp_path / "landing_source.py"))
    names = [str(tmp_path / "remote" / f"{x}-1h-2024-01-01.zip") for x in "ABC"]
    (tmp_path / "remote" / "C-1h-2024-01-01.zip").write_bytes(b"not yet")
    available = spark.createDataFrame([(n,) for n in names], "path string")
    failed = ingest.land(available, str(tmp_path / "landing"), "landing_source:get")
    assert [r["file"] for r in failed.collect()] == names[2:]
    (tmp_path / "remote" / "C-1h-2024-01-01.zip").write_bytes((tmp_path / "remote" / "A-1h-2024-01-01.zip").read_bytes())
    assert ingest.land(available, str(tmp_path / "landing"), "landing_source:get").count() == 0
    assert ingest.land(available, str(tmp_path / "landing"), "landing_source:get").count() == 0
    assert sorted(r["file"] for r in spark.read.parquet(str(tmp_path / "landing" / "bars")).collect()) == names
    assert [len(open(n + ".log").read()) for n in names] == [1, 1, 2]


def test_polling(spark, tmp_path):
    """Symbols x types x intervals from where the store ends; a failing series loses no other's bars."""
    (tmp_path / "poll_source.py").write_text(
        "def rows(symbol, kind, interval, start, limit):\n"
        "    if symbol == 'BAD' and kind == 'spot':\n        raise OSError('down')\n"
        "    have = [[t, 1, 3, 0.5, 2, 10, t + 99, 20, 5, 1, 2, 0] for t in range(0, 1000, 100)]\n"
        "    return [r for r in have if r[0] >= start][:limit]\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "poll_source.py"))
    store = KlineStore(spark, str(tmp_path / "store"))
    store.upsert(bars(spark, [raw(0), raw(300)]).withColumn("kline_type", F.lit("spot")))
    args = ("poll_source:rows", ["AUSDT", "BAD"], ["spot", "mark"], ["1h", "1d"], "x")
    log = str(tmp_path / "errors")
    failed = updates.poll(store, *args, options={"limit": "4", "retries": "1", "wait": "0"}, errors=log)
    assert sorted((r["symbol"], r["kline_type"], r["interval"], r["error_message"]) for r in failed.collect()) == [("BAD", "spot", "1d", "down"), ("BAD", "spot", "1h", "down")]
    got = {(r["symbol"], r["kline_type"], r["interval"]): r["n"] for r in store.read().groupBy("symbol", "kline_type", "interval").agg(F.count("*").alias("n")).collect()}
    assert got == {("AUSDT", "spot", "1h"): 8, ("AUSDT", "spot", "1d"): 10, ("AUSDT", "mark", "1h"): 10, ("AUSDT", "mark", "1d"): 10, ("BAD", "mark", "1h"): 10, ("BAD", "mark", "1d"): 10}
    before = store.read().count()
    updates.poll(store, *args, options={"retries": "0"}, errors=log)
    assert store.read().count() == before and klines.retry_list(spark.read.json(log)).count() == 2


def test_zipped_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for k in range(3):
        with zipfile.ZipFile(land / f"AUSDT-1h-2024-01-0{k + 1}.zip", "w") as z:
            z.writestr("x.csv", ",".join(map(str, raw(100 * k))) + "\n")
    (land / "BUSDT-1h-2024-01-01.zip").write_bytes(b"no zip")
    store = KlineStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        updates.upsert_stream(updates.zip_files(spark, str(land), 2), store, str(tmp_path / "cp"), KEYS | {"symbol": "AUSDT"}).awaitTermination()
    assert sorted(r["timestamp"] for r in store.read().collect()) == [0, 100, 200]


def test_fake_tails(spark):
    rows = [(s, t, 1.0, 1.0, 1.0, 1.0, 0.0 if flat else 5.0) for s, flags in (("a", [0, 1, 0, 1, 1]), ("b", [0, 1]), ("c", [1, 1]), ("d", [0, 0])) for t, flat in enumerate(flags)]
    df = spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double")
    active = spark.createDataFrame([("b",)], "symbol string")
    got = {r["symbol"]: (r["action"], r["before"], r["after"]) for r in quality.cleanup_report(df, active).collect()}
    assert got == {"a": ("truncate", 5, 3), "b": ("keep active", 2, 2), "c": ("truncate", 2, 0), "d": ("clean", 2, 2)}
    once = quality.cleanup(df, active)
    assert once.count() == 7 and quality.cleanup(once, active).count() == 7
    with pytest.raises(ValueError):
        quality.cleanup(df, active.where("false"))


def test_streams(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for k in range(3):
        (land / f"{k}.csv").write_text("\n".join(",".join(map(str, raw(t))) for t in range(100 * k, 100 * k + 200, 100)) + "\n")
    store = KlineStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        updates.upsert_stream(updates.bar_files(spark, str(land), ingest.RAW, 1), store, str(tmp_path / "cp"), KEYS | {"symbol": "AUSDT"}).awaitTermination()
    assert sorted(r["timestamp"] for r in store.read().collect()) == [0, 100, 200, 300]

    events = tmp_path / "events"
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [("a", t0 + timedelta(seconds=20 * k), float(k), 1.0) for k in range(10)] + [("a", t0 + timedelta(hours=1), 0.0, 0.0)]
    spark.createDataFrame(rows, "s string, ts timestamp, p double, v double").coalesce(1).write.parquet(str(events))
    stream = spark.readStream.schema("s string, ts timestamp, p double, v double").parquet(str(events))
    q = updates.tumbling_bars(stream, "1 minute", "1 minute", "s", "ts", "p", "v").writeStream.format("memory").queryName("bars_out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.sql("select * from bars_out order by ts").collect()]
    assert got == [(0.0, 2.0, 0.0, 2.0, 3.0), (3.0, 5.0, 3.0, 5.0, 3.0), (6.0, 8.0, 6.0, 8.0, 3.0), (9.0, 9.0, 9.0, 9.0, 1.0)]

    log = tmp_path / "errors"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps({"symbol": "a", "interval": "1h", "kline_type": "spot"}) for _ in range(2)))
    src = spark.readStream.schema("symbol string, interval string, kline_type string").json(str(tmp_path / "in"))
    updates.failed_rows(src, str(log), str(tmp_path / "cp2")).awaitTermination()
    assert klines.retry_list(spark.read.json(str(log))).count() == 1


def test_made_up_bars_repeat(spark):
    a, b = (ingest.made_up_bars(spark, 2, 5).orderBy("symbol", "open_time").collect() for _ in range(2))
    assert a == b and len(a) == 10 and all(r["low"] <= min(r["open"], r["close"]) and r["high"] >= max(r["open"], r["close"]) for r in a)
