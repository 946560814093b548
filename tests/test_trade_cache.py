"""Trades cached by day: a counting source sees what is missing and nothing else."""

import pytest

from candela.errors import CoverageError, InvalidBarQuery
from candela.functions.timeframe import DAY, Timeframe
from candela.plans.query import FootprintQuery, Instrument
from candela.plans.trades import TradeCache, cached_footprint, subtracted

HOUR = 3_600_000
I = Instrument("binance", "spot", "S")


def test_intervals_are_subtracted():
    assert subtracted(0, 10, []) == [(0, 10)] and subtracted(0, 10, [(0, 10)]) == [] and subtracted(0, 10, [(-5, 20)]) == []
    assert subtracted(0, 10, [(2, 4), (3, 5), (7, 8), (5, 6)]) == [(0, 2), (6, 7), (8, 10)] and subtracted(0, 10, [(12, 14), (-3, 1)]) == [(1, 10)]


@pytest.fixture
def market(spark):
    """A trade every half hour of two days, none in hours 5 and 30; the source gives whole hours, so more than asked for."""
    rows = [(k, k * HOUR // 2, 100.0 + k, 1.0, k % 3 == 0) for k in range(96) if k // 2 not in (5, 30)]
    trades = spark.createDataFrame(rows, "trade_id long, time long, price double, quantity double, buyer_maker boolean")
    asked = []
    return trades, asked, lambda a, b: (asked.append((a // HOUR, b // HOUR)), trades.where(f"time >= {a - HOUR} AND time < {b + HOUR}"))[1]


def test_only_missing_time_is_fetched(spark, market, tmp_path):
    trades, asked, source = market
    cache = TradeCache(spark, f"{tmp_path}/trades")
    ids = lambda rows: sorted(r.trade_id for r in rows.collect())
    want = lambda a, b: ids(trades.where(f"time >= {a * HOUR} AND time < {b * HOUR}"))
    assert ids(cache.get(I, 3 * HOUR, 6 * HOUR, source)) == want(3, 6)
    assert ids(cache.get(I, 20 * HOUR, 28 * HOUR, source)) == want(20, 28)
    assert ids(cache.get(I, 0, 2 * DAY, source)) == want(0, 48)
    assert asked == [(3, 6), (20, 28), (0, 3), (6, 20), (28, 48)]
    assert ids(cache.get(I, HOUR, 40 * HOUR, source)) == want(1, 40) and len(asked) == 5
    assert cache.get(Instrument("binance", "spot", "OTHER"), 0, HOUR, lambda a, b: trades.where("false")).count() == 0
    assert cache.missing(Instrument("binance", "spot", "OTHER"), 0, 2 * HOUR) == [(HOUR, 2 * HOUR)]  # an hour without trades is covered


def test_a_fetch_that_died_is_unseen(spark, market, tmp_path, monkeypatch):
    trades, asked, source = market
    cache = TradeCache(spark, f"{tmp_path}/trades")
    cache.get(I, 0, 2 * HOUR, source)
    real = spark.range
    monkeypatch.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))  # trades are written, their interval isn't
    with pytest.raises(RuntimeError):
        cache.get(I, 0, 6 * HOUR, source)
    monkeypatch.undo()
    assert real and cache.read(I, 0, 6 * HOUR).count() == 4
    assert cache.get(I, 0, 6 * HOUR, source).count() == 10 and asked[1:] == [(2, 6), (2, 6)]


def test_the_future_stays_missing(spark, market, tmp_path):
    _, asked, source = market
    cache = TradeCache(spark, f"{tmp_path}/trades")
    cache.get(I, 0, 10 * HOUR, source, until=4 * HOUR)
    assert cache.missing(I, 0, 10 * HOUR) == [(4 * HOUR, 10 * HOUR)] and asked == [(0, 4)]


def test_footprints_tell_what_they_lack(spark, market, tmp_path):
    _, asked, source = market
    cache = TradeCache(spark, f"{tmp_path}/trades")
    query = lambda a, b, **more: FootprintQuery(I, Timeframe.parse("1h"), a * HOUR, b * HOUR, 10.0, **more)
    found = cached_footprint(query(3, 8), cache, source)
    assert [r.start // HOUR for r in found.missing.collect()] == [5] and found.delivered_end == 8 * HOUR
    assert sorted({r.time // HOUR for r in found.levels.collect()}) == [3, 4, 6, 7]
    with pytest.raises(CoverageError):
        cached_footprint(query(3, 8, gap_policy="fail"), cache, source)
    assert cached_footprint(query(6, 8, gap_policy="fail"), cache, source).missing.isEmpty() and asked == [(3, 8)]
    with pytest.raises(InvalidBarQuery):
        query(0, 1, gap_policy="perhaps")
    ticks = FootprintQuery(I, Timeframe.parse("1h"), 0, HOUR, tick_size=0.5)
    assert ticks.bucket_size == 0.5
    none = cached_footprint(query(100, 102), cache, source)
    assert none.delivered_end is None and none.missing.count() == 2
