"""Which bars answer a query, and where they come from."""

import pytest
from pyspark.sql import functions as F

from candela import errors
from candela.functions.timeframe import DAY, Timeframe, close_time
from candela.plans.provider import Settings, archive_cutoff, fetch_bars, fetch_footprint, footprint_coverage, kept_in, stored_footprint
from candela.plans.query import BarQuery, FootprintQuery, Instrument
from candela.store import BarStore, FootprintStore

MINUTE = 60_000
I = Instrument("binance", "spot", "S")


def series(spark, times, value, timeframe="1m"):
    rows = [("binance", "spot", "S", timeframe, t, value, value, value, value, 1.0) for t in times]
    made = spark.createDataFrame(rows, "exchange string, market string, symbol string, timeframe string, time long, open double, high double, low double, close double, volume double")
    return made.withColumn("time_close", close_time(F.col("time"), timeframe))


def source(spark, value, asked):
    def get(query):
        asked.append((query.start_ms, query.end_ms, query.timeframe.canonical))
        return series(spark, range(query.start_ms, query.end_ms, MINUTE), value)

    return get


def query(name, start, end):
    return BarQuery(I, Timeframe.parse(name), start, end)


def test_cutoff():
    assert archive_cutoff(10 * DAY + 5, 2) == 8 * DAY


def test_stored_bars_answer_alone(spark):
    asked = []
    found = fetch_bars(query("1m", 0, 3 * MINUTE), series(spark, [0, MINUTE, 2 * MINUTE], 1.0), None, source(spark, 9.0, asked), 0)
    assert found.count() == 3 and asked == []


def test_sources_split_at_the_cutoff_and_fill_holes(spark):
    asked = []
    stored = series(spark, [0, 2 * MINUTE], 1.0)
    found = fetch_bars(query("1m", 0, 5 * MINUTE), stored, source(spark, 2.0, asked), source(spark, 3.0, asked), 3 * MINUTE)
    assert [(r.time // MINUTE, r.open) for r in found.orderBy("time").collect()] == [(0, 1), (1, 2), (2, 1), (3, 3), (4, 3)]
    assert asked == [(MINUTE, 2 * MINUTE, "1m"), (3 * MINUTE, 5 * MINUTE, "1m")]


def test_only_holes_are_fetched_and_kept(spark, tmp_path):
    """A counting source sees the holes once; what it gave is stored, and a second query asks for nothing."""
    asked, store = [], BarStore(spark, f"{tmp_path}/store")
    store.write_closed(series(spark, [0, MINUTE, 4 * MINUTE, 7 * MINUTE], 1.0))
    get = lambda q: fetch_bars(q, store.read(q), None, source(spark, 5.0, asked), 0, keep=kept_in(store))
    found = get(query("1m", 0, 9 * MINUTE))
    assert sorted((r.time // MINUTE, r.open) for r in found.collect()) == [(0, 1), (1, 1), (2, 5), (3, 5), (4, 1), (5, 5), (6, 5), (7, 1), (8, 5)]
    assert asked == [(2 * MINUTE, 4 * MINUTE, "1m"), (5 * MINUTE, 7 * MINUTE, "1m"), (8 * MINUTE, 9 * MINUTE, "1m")]
    assert get(query("1m", 0, 9 * MINUTE)).count() == 9 and len(asked) == 3
    many = fetch_bars(query("1m", 0, 9 * MINUTE), series(spark, [0, 2 * MINUTE, 4 * MINUTE], 1.0), None, source(spark, 5.0, asked), 0, settings=Settings(most_fetches=2))
    assert many.count() == 9 and asked[3:] == [(MINUTE, 9 * MINUTE, "1m")]


def test_footprints_are_stored_and_report_their_coverage(spark, tmp_path):
    rows = [("S", k, k * MINUTE + 5, 100.0 + k, 1.0, False) for k in range(3)]
    trades = spark.createDataFrame(rows, "symbol string, trade_id long, time long, price double, quantity double, buyer_maker boolean")
    asked = FootprintQuery(I, Timeframe.parse("1m"), 0, 3 * MINUTE, 10.0)
    calls = []
    raw = lambda a, b: (calls.append((a, b)), trades)[1]
    store = FootprintStore(spark, f"{tmp_path}/footprints")
    assert stored_footprint(asked, store, raw).count() == 3 and stored_footprint(asked, store, raw).count() == 3
    assert calls == [(0, 3 * MINUTE)]
    cover = lambda end: tuple(footprint_coverage(fetch_footprint(FootprintQuery(I, Timeframe.parse("1m"), 0, end, 10.0), trades), FootprintQuery(I, Timeframe.parse("1m"), 0, end, 10.0)).first())
    assert cover(3 * MINUTE) == (3, 0, "valid", 3 * MINUTE) and cover(5 * MINUTE) == (3, 2, "gap", 3 * MINUTE)
    none = FootprintQuery(I, Timeframe.parse("1m"), 9 * MINUTE, 10 * MINUTE, 10.0)
    assert tuple(footprint_coverage(fetch_footprint(none, trades), none).first()) == (0, 1, "empty", None)
    with pytest.raises(errors.CoverageError):
        fetch_footprint(FootprintQuery(I, Timeframe.parse("1m"), 9 * MINUTE, 10 * MINUTE, 10.0, gap_policy="strict"), trades)


def test_derives_from_the_base(spark):
    asked = []
    found = fetch_bars(query("5m", 0, 10 * MINUTE), None, None, source(spark, 4.0, asked), 0).collect()
    assert [(r.time, r.volume, r.timeframe) for r in sorted(found)] == [(0, 5, "5m"), (5 * MINUTE, 5, "5m")] or len(found) == 2
    assert asked[0][2] == "1m"
    other = fetch_bars(query("5m", 0, 10 * MINUTE), None, None, lambda q: series(spark, [0, 5 * MINUTE], 1.0, "5m"), 0, settings=Settings(derive_for=()))
    assert other.count() == 2


def test_partial_coverage_is_an_error_and_none_is_not(spark):
    nothing = lambda q: series(spark, [], 1.0)
    assert fetch_bars(query("1m", 0, 3 * MINUTE), None, None, nothing, 0).count() == 0
    with pytest.raises(errors.CoverageError):
        fetch_bars(query("1m", 0, 3 * MINUTE), None, None, lambda q: series(spark, [0, 2 * MINUTE], 1.0), 0)


def test_current_candle_is_laid_over(spark):
    found = fetch_bars(query("1m", 0, 2 * MINUTE), series(spark, [0, MINUTE], 1.0), None, lambda q: None, 0, current=series(spark, [MINUTE, 5 * MINUTE], 7.0))
    assert sorted(r.open for r in found.collect()) == [1, 1]


def test_strict_footprints(spark):
    trades = spark.createDataFrame([("S", 1, 1000, 100.1, 1.0, False)], "symbol string, trade_id long, time long, price double, quantity double, buyer_maker boolean")
    asked = FootprintQuery(I, Timeframe.parse("1m"), 0, 2 * MINUTE, 10.0)
    assert fetch_footprint(asked, trades).count() == 1
    with pytest.raises(errors.CoverageError):
        fetch_footprint(FootprintQuery(I, Timeframe.parse("1m"), 0, 2 * MINUTE, 10.0, gap_policy="strict"), trades)
