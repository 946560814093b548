"""Archives by day and month: planning, unpacking, and filling of ranges."""

import zipfile
from datetime import datetime, timedelta, timezone

import pytest

from candela import errors
from candela.functions.timeframe import Timeframe
from candela.plans import archives
from candela.plans.provider import fetch
from candela.plans.query import BarQuery, Instrument

DAY, HOUR = 86_400_000, 3_600_000
START = 1_704_067_200_000  # 2024-01-01
MONTH = 31


def _zip(root, period, date, times, *, micros=False):
    folder = root / "spot" / period / "BTCUSDT" / "1h"
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["open_time,open,high,low,close,volume\n"] if micros else []
    lines += [f"{t * 1000 if micros else t},{k}.10,{k + 2},{k},{k + 1},1.50,{t + HOUR - 1}\n" for t, k in ((t, (t - START) // HOUR + 1) for t in times)]
    with zipfile.ZipFile(folder / f"BTCUSDT-1h-{date}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"BTCUSDT-1h-{date}.csv", "".join(lines))


def _hours(day, count=24):
    return [START + day * DAY + h * HOUR for h in range(count)]


def _date(day):
    return (datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=day)).strftime("%Y-%m-%d")


def _query(days=MONTH, start=START):
    return BarQuery(Instrument("binance", "spot", "BTCUSDT"), Timeframe.parse("1h"), start, start + days * DAY)


def _names(plan):
    return sorted({r.path.split("/")[-1].removeprefix("BTCUSDT-1h-").removesuffix(".zip") for r in plan.collect() if r.path})


def _layouts(tmp_path):
    whole = [t for d in range(MONTH) for t in _hours(d)]
    for d in range(MONTH):
        _zip(tmp_path / "days", "daily", _date(d), _hours(d))
    _zip(tmp_path / "month", "monthly", "2024-01", whole, micros=True)
    for d in range(20):  # days 20 to 30 have no file, day 3 lacks its last hours
        _zip(tmp_path / "mixed", "daily", _date(d), _hours(d, 20 if d == 3 else 24))
    _zip(tmp_path / "mixed", "monthly", "2024-01", whole)


def test_three_layouts_of_a_month_give_the_same_bars(spark, tmp_path):
    _layouts(tmp_path)
    columns = ("time", "time_close", "open", "high", "low", "close", "volume", "open_text", "volume_text", "exchange", "market", "symbol", "timeframe", "is_closed")
    made = {x: archives.archive_bars(spark, _query(), root=f"{tmp_path}/{x}").select(*columns).orderBy("time").collect() for x in ("days", "month", "mixed")}
    assert made["days"] == made["month"] == made["mixed"] and len(made["days"]) == MONTH * 24
    assert made["days"][0][:9] == (START, START + HOUR - 1, 1.1, 3, 1, 2, 1.5, "1.10", "1.50")
    asked = spark.createDataFrame([("spot", "BTCUSDT", "1h", START, START + MONTH * DAY)], "market string, symbol string, interval string, start long, end long")
    files = {x: _names(archives.planned(asked, archives.listing(spark, f"{tmp_path}/{x}"))) for x in made}
    assert files == {"days": [_date(d) for d in range(MONTH)], "month": ["2024-01"], "mixed": ["2024-01", *[_date(d) for d in range(20)]]}


def test_limits_choose_days_months_or_nothing(spark, tmp_path):
    _layouts(tmp_path)
    files = archives.listing(spark, f"{tmp_path}/mixed")
    asked = lambda days: spark.createDataFrame([("spot", "BTCUSDT", "1h", START, START + days * DAY)], "market string, symbol string, interval string, start long, end long")
    plan = lambda n, **limits: _names(archives.planned(asked(n), files, limits=archives.Limits(**limits)))
    assert plan(2) == [_date(0), _date(1)]
    assert plan(46) == ["2024-01"]  # more than 45 days: by month
    assert plan(31, days=30) == ["2024-01"] and plan(31, days=30, months=0) == []
    assert plan(400) == [] and plan(400, months=None) == ["2024-01"]
    rows = archives.planned(asked(32), files).orderBy("day").collect()
    assert [r.period for r in rows] == ["daily"] * 20 + ["monthly"] * 11 + [None] and len(rows) == 32
    # A day whose file lacks hours: the month is read as well, and no more than that.
    bars = archives.archive_bars(spark, _query(1, START + 3 * DAY), root=f"{tmp_path}/mixed")
    assert [r.time for r in bars.orderBy("time").collect()] == _hours(3)


def test_an_archive_is_a_source_of_the_provider_plan(spark, tmp_path):
    _layouts(tmp_path)
    source = archives.archive_source(spark, f"{tmp_path}/days")
    query = _query(2)
    assert fetch(query, source, source, START + DAY).count() == 48
    assert source(_query(3, START - 2 * DAY)).count() == 24
    assert source(BarQuery(Instrument("binance", "spot", "ETHUSDT"), Timeframe.parse("1h"), START, START + DAY)).count() == 0


def test_archives_that_cannot_be_read_stop_the_job(spark, tmp_path):
    _zip(tmp_path, "daily", _date(0), _hours(0))
    place = tmp_path / "spot" / "daily" / "BTCUSDT" / "1h"
    (place / f"BTCUSDT-1h-{_date(1)}.zip").write_bytes(b"no archive")
    (place / "notes-1h-2024-01-01.zip").write_bytes(b"")  # another name: not listed
    assert archives.archive_bars(spark, _query(1), root=str(tmp_path)).count() == 24
    with pytest.raises(errors.InvalidExchangeResponse), errors.from_jobs():
        archives.archive_bars(spark, _query(2), root=str(tmp_path)).collect()
    with zipfile.ZipFile(place / f"BTCUSDT-1h-{_date(1)}.zip", "w") as z:
        z.writestr("a.txt", "0,1")
        z.writestr("k.csv", f"time,open\n\n{START + DAY},1,2,x,1,1\n")
    with pytest.raises(errors.InvalidExchangeResponse), errors.from_jobs():
        archives.archive_bars(spark, _query(2), root=str(tmp_path)).collect()
