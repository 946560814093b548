"""Files of bars read in order and checked, and the cache of segments."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from candela import errors
from candela.functions.timeframe import Timeframe
from candela.plans.query import BarQuery, Instrument
from candela.sources import offline
from candela.sources.cache import SegmentCache

MINUTE = 60_000


def file(tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    return f"{tmp_path}/a.csv"


def test_rows_of_a_file_come_by_time(spark, tmp_path):
    path = file(tmp_path, "time,open,high,low,close,volume,symbol\n120000,1,2,0.5,1,1,X\n0,1,2,0.5,1,,Y\n60000,1,2,0.5,1,3,Z\n")
    found = offline.read_bars(spark, path, "1m").collect()
    assert [(r.time, r.volume, r.time_close) for r in found] == [(0, 0.0, 59_999), (60_000, 3.0, 119_999), (120_000, 1.0, 179_999)]
    assert [r.time for r in offline.read_bars(spark, path, "1m", start=1, max_bars=1).collect()] == [60_000]
    spark.read.csv(path, header=True).selectExpr("cast(time as int) time", "cast(open as float) open", "high", "low", "close", "volume").write.parquet(f"{tmp_path}/a.parquet")
    assert [(r.time, r.open, r.high, r.volume) for r in offline.read_bars(spark, f"{tmp_path}/a.parquet", "1m", end=60_001).collect()] == [(0, 1.0, 2.0, 0.0), (60_000, 1.0, 2.0, 3.0)]
    with pytest.raises(errors.UnsupportedFeature):
        offline.read_bars(spark, f"{tmp_path}/a.json", "1m")


@pytest.mark.parametrize("row", ["0,1,0.5,0.5,1,1", "0,x,2,0.5,1,1", "0,1,2,0.5,,1", ",1,2,0.5,1,1", "0,1,2,0.5,1,-1", "now,1,2,0.5,1,1", "60000,1,2,0.5,1,1"])
def test_wrong_rows_of_a_file_carry_a_code(spark, tmp_path, row):
    with pytest.raises(errors.ValidationError, match="MD_VALIDATION_ERROR"):
        offline.read_bars(spark, file(tmp_path, f"time,open,high,low,close,volume\n60000,1,2,0.5,1,1\n{row}\n"), "1m")


def bars(spark, symbol, times, close=1.1):
    rows = spark.createDataFrame([(t * MINUTE,) for t in times], "time long")
    return rows.selectExpr("'okx' exchange", "'spot' market", f"'{symbol}' symbol", "'1m' timeframe", "time", "1.0D open", "2.0D high", "0.1D low", f"{close}D close", "0.30000000000000004D volume", f"time + {MINUTE - 1} time_close", "'x' note")


def asked(symbol, start, end):
    return BarQuery(Instrument("okx", "spot", symbol), Timeframe.parse("1m"), start * MINUTE, end * MINUTE)


def test_segments_are_read_as_written(spark, tmp_path):
    cache = SegmentCache(spark, f"{tmp_path}/cache")
    with pytest.raises(errors.UnsupportedFeature):
        cache.read(asked("A/B", 0, 9))
    facts = cache.write(bars(spark, "A/B", range(5)).union(bars(spark, "C", range(3))), start=0, end=5 * MINUTE).collect()
    assert sorted((r.symbol, r.bars, r.first_time, r.last_time, r.end) for r in facts) == [("A/B", 5, 0, 4 * MINUTE, 5 * MINUTE), ("C", 3, 0, 2 * MINUTE, 5 * MINUTE)]
    found = cache.read(asked("A/B", 1, 9), max_bars=2).collect()
    assert [(r.time, r.close, r.volume) for r in found] == [(MINUTE, 1.1, 0.30000000000000004), (2 * MINUTE, 1.1, 0.30000000000000004)]
    with pytest.raises(errors.UnsupportedFeature):
        cache.read(asked("D", 0, 9))
    cache.write(bars(spark, "A/B", [7], close=1.5))  # replaces one segment, the other stays
    assert sorted((r.symbol, r.time // MINUTE) for r in cache.read_all().collect()) == [("A/B", 7), ("C", 0), ("C", 1), ("C", 2)]
    cache.write(bars(spark, "C", [1]))
    assert cache.prune() == 1 and cache.read_all().count() == 2


def test_a_changed_segment_is_not_read_and_others_are(spark, tmp_path):
    cache = SegmentCache(spark, f"{tmp_path}/cache")
    cache.write(bars(spark, "A", range(5)).union(bars(spark, "C", range(3))))
    for name in Path(f"{tmp_path}/cache").rglob("symbol=A/**/*.csv"):
        name.write_text(name.read_text().replace("1.1", "1.2", 1))
        (name.parent / f".{name.name}.crc").unlink(missing_ok=True)
    with pytest.raises(errors.InvalidExchangeResponse, match="checksum"):
        cache.read(asked("A", 0, 9))
    with pytest.raises(errors.InvalidExchangeResponse, match="checksum"):
        cache.read_all()
    assert cache.read(asked("C", 0, 9)).count() == 3


def test_wrong_bars_and_writes_cut_off_make_no_segment(spark, tmp_path):
    cache = SegmentCache(spark, f"{tmp_path}/cache")
    cache.write(bars(spark, "A", range(2)))
    with pytest.raises(errors.ValidationError):
        cache.write(bars(spark, "A", [5, 5]))
    with pytest.raises(errors.ValidationError):
        cache.write(bars(spark, "A", [6]).withColumn("high", F.lit(0.5)))
    assert [r.time for r in cache.read(asked("A", 0, 9)).collect()] == [0, MINUTE]
    cache.write(bars(spark, "A", []))
    assert cache.read_all().count() == 2 and cache.prune() == 3
