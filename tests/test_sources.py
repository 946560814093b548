"""Recorded payloads as a data source: what is read, what a stream resumes from, and what a provider keeps of them."""

import json

import pytest
from pyspark.sql import functions as F

from candela.functions.timeframe import Timeframe
from candela.plans.provider import fetch_bars, kept_in
from candela.plans.query import BarQuery, Instrument
from candela.sources import recorded
from candela.store import BarStore
from candela.streaming.klines import each_batch

HOUR = 3_600_000


def page(spark, symbol, start, end, close=1.5, exchange="okx", text=None):
    rows = [[str(t), "1", "2", "0.5", str(close), "3"] for t in range(start, end, HOUR)]
    payload = text or json.dumps({"data": rows}, indent=1)
    return spark.createDataFrame([(exchange, "spot", symbol, "1h", start, end, payload)], "exchange string, market string, symbol string, timeframe string, start long, end long, payload string")


def asked(start, end, symbol="A/B", exchange="okx"):
    return BarQuery(Instrument(exchange, "spot", symbol), Timeframe.parse("1h"), start, end)


@pytest.fixture
def recording(spark, tmp_path):
    path = f"{tmp_path}/recorded"
    recorded.register(spark)
    for k in range(4):
        recorded.record(page(spark, "A/B", 10 * k * HOUR, 10 * (k + 1) * HOUR), path)
    recorded.record(page(spark, "OTHER", 0, 10 * HOUR, text="no payload"), path)
    recorded.record(page(spark, "A/B", 0, 10 * HOUR, exchange="bybit", text="no payload"), path)
    return path


def test_conditions_choose_folders(recording):
    reader = recorded.KlineReader({"path": recording})
    assert len(reader.pages(reader.batches())) == 6
    from pyspark.sql import datasource as D

    left = list(reader.pushFilters([D.EqualTo(("symbol",), "A/B"), D.In(("exchange",), ("okx", "htx")), D.GreaterThan(("end",), 15 * HOUR), D.LessThan(("start",), 25 * HOUR), D.IsNotNull(("start",)), D.StringContains(("payload",), "x")]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    assert [(v[0], v[5] // HOUR, v[6] // HOUR) for p in reader.partitions() for _, v in p.value] == [(2, 10, 20), (3, 20, 30)]


def test_a_range_reads_its_pages_alone(spark, recording):
    found = recorded.recorded(spark, recording)(asked(12 * HOUR, 23 * HOUR))
    assert sorted(r.time // HOUR for r in found.collect()) == list(range(12, 23))  # pages of other series would stop the job
    pages = recorded.pages_of(spark, recording, asked(12 * HOUR, 23 * HOUR))
    assert sorted(r.batch for r in pages.collect()) == [2, 3]
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # all conditions were taken over
    many = spark.read.format("klines").option("pagesPerPartition", 1).load(recording)
    assert many.rdd.getNumPartitions() == 6 and spark.read.format("klines").load(recording).rdd.getNumPartitions() == 1
    assert many.where("symbol = 'NONE'").count() == 0


def test_batches_without_marker_are_unseen(spark, recording):
    import os

    os.remove(f"{recording}/batch=4/_SUCCESS")
    assert recorded.Listing({"path": recording}).batches() == [1, 2, 3, 5, 6]
    assert recorded.Listing({"path": f"{recording}/none"}).batches() == []


def test_later_pages_win_and_closed_ones_first(spark, tmp_path):
    path = f"{tmp_path}/twice"
    recorded.record(page(spark, "A/B", 0, 3 * HOUR - 1, close=1.0), path)  # its last candle is still open
    recorded.record(page(spark, "A/B", 0, 3 * HOUR, close=1.25), path)
    recorded.record(page(spark, "A/B", 2 * HOUR, 3 * HOUR - 5, close=1.75), path)
    found = recorded.recorded(spark, path)(asked(0, 3 * HOUR))
    assert sorted((r.time // HOUR, r.close, r.is_closed) for r in found.collect()) == [(0, 1.25, True), (1, 1.25, True), (2, 1.25, True)]


def test_a_stream_goes_on_behind_its_checkpoint(spark, recording, tmp_path):
    seen = []

    def run():
        stream = spark.readStream.format("klines").load(recording).where("symbol = 'A/B' AND exchange = 'okx'")
        each_batch(recorded.bars_of_pages(stream, "okx", "1h"), lambda rows, k: seen.append((k, rows.count())), f"{tmp_path}/state")

    run()
    run()
    assert seen == [(0, 40)]
    recorded.record(page(spark, "A/B", 40 * HOUR, 45 * HOUR), recording)
    recorded.record(page(spark, "A/B", 45 * HOUR, 46 * HOUR), recording)
    run()
    assert seen == [(0, 40), (1, 6)]


def test_an_open_candle_is_asked_for_again(spark, tmp_path):
    """A fetch whose last candle is open shows it and doesn't store it; once it has closed, its last values count."""
    path, store, calls = f"{tmp_path}/live", BarStore(spark, f"{tmp_path}/store"), []
    inner = recorded.recorded(spark, path)
    source = lambda q: (calls.append((q.start_ms // HOUR, q.end_ms // HOUR)), inner(q))[1]
    get = lambda: fetch_bars(asked(0, 3 * HOUR), store.read(asked(0, 3 * HOUR)) if store.versions() else None, None, source, 0, keep=kept_in(store))
    recorded.record(page(spark, "A/B", 0, 3 * HOUR - 1, close=1.1), path)
    assert sorted((r.time // HOUR, r.close, r.is_closed) for r in get().collect()) == [(0, 1.1, True), (1, 1.1, True), (2, 1.1, False)]
    assert store.manifest().first().rows_count == 2
    recorded.record(page(spark, "A/B", 2 * HOUR, 3 * HOUR, close=1.9), path)
    assert sorted((r.time // HOUR, r.close, r.is_closed) for r in get().collect()) == [(0, 1.1, True), (1, 1.1, True), (2, 1.9, True)]
    assert get().count() == 3 and calls == [(0, 3), (2, 3)]


def test_kinds_of_candles_are_series_of_their_own(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/kinds")
    recorded.record(page(spark, "A/B", 0, 3 * HOUR), f"{tmp_path}/r")
    bars = recorded.recorded(spark, f"{tmp_path}/r")(asked(0, 3 * HOUR))
    store.write_closed(bars)
    store.write_closed(bars.withColumn("source_kind", F.lit("mark_kline")).withColumn("close", F.lit(1.75)))
    read = lambda kind: {r.close for r in store.read(BarQuery(asked(0, 1).instrument, Timeframe.parse("1h"), 0, 3 * HOUR, kind)).collect()}
    assert read("trade_kline") == {1.5} and read("mark_kline") == {1.75} and store.manifest().count() == 2 and store.verify().isEmpty()


def test_columns_that_come_later_are_kept_and_compared(spark, tmp_path):
    from candela.errors import CacheConflict, ValidationError

    store = BarStore(spark, f"{tmp_path}/later")
    recorded.record(page(spark, "A/B", 0, 6 * HOUR), f"{tmp_path}/r")
    bars = recorded.recorded(spark, f"{tmp_path}/r")(asked(0, 6 * HOUR))
    first, second, third = (bars.where(f"time >= {a * HOUR} AND time < {b * HOUR}") for a, b in ((0, 2), (2, 4), (4, 6)))
    store.write_closed(first)
    store.write_closed(second.withColumn("trades_count", F.lit(7).cast("long")))
    store.write_closed(third)
    assert [r.trades_count for r in store.read_all().orderBy("time").collect()] == [None, None, 7, 7, None, None]
    assert store.verify().isEmpty() and store.compact() == 4 and store.verify().isEmpty()
    assert store.write_closed(second.withColumn("trades_count", F.lit(7).cast("long"))) == {"new": 0, "duplicate": 2}
    with pytest.raises(CacheConflict):
        store.write_closed(second.withColumn("trades_count", F.lit(8).cast("long")))
    with pytest.raises(ValidationError):
        store.merge(first.withColumn("trades_count", F.lit("many")))
    store.merge(first.withColumn("close", F.lit(1.0)))  # a batch of fewer columns
    assert [r.close for r in store.read_all().orderBy("time").collect()] == [1.0, 1.0, 1.5, 1.5, 1.5, 1.5]


def test_a_series_is_read_from_its_own_folders(spark, tmp_path):
    """Many series and commits: what a read of one opens are that one's files."""
    store = BarStore(spark, f"{tmp_path}/many")
    rows = spark.range(30).selectExpr("'okx' exchange", "'spot' market", "concat('S/', id) symbol", "'1h' timeframe")
    for k in range(4):
        bars = rows.selectExpr("*", f"{k * HOUR}L time", "1.0D open", "1.0D high", "1.0D low", "1.0D close", "1.0D volume", f"{(k + 1) * HOUR - 1}L time_close")
        store.append_newer(bars)
    found = store.read(asked(0, 9 * HOUR, "S/7"))
    files = found.inputFiles()
    assert found.count() == 4 and len(files) == 4 and all("symbol=S%252F7" in f or "symbol=S%2F7" in f for f in files)
    assert store.latest().count() == 30 and store.get({"exchange": "okx", "market": "spot", "symbol": "S/7", "timeframe": "1h"}, HOUR).count() == 1
