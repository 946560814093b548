"""Raw payloads, footprints, interval names, recorded payloads and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from candela import cli, errors
from candela.functions.timeframe import Timeframe, pages, public_interval, requested_limit
from candela.plans.query import FootprintQuery, Instrument
from candela.sources import decode, offline
from candela.store import FootprintStore, RawStore

HOUR = 3_600_000


def test_interval_names():
    assert [public_interval(x, "okx") for x in ("1m", "1h", "4h", "1D")] == ["1m", "1H", "4H", "1D"]
    assert [public_interval(x, "htx") for x in ("5m", "60", "4h", "1d")] == ["5min", "60min", "4hour", "1day"]
    assert [public_interval(x, "mexc-contract") for x in ("15m", "1h", "4h", "D")] == ["Min15", "Min60", "Hour4", "Day1"]
    assert [public_interval(x, "coinbase") for x in ("1m", "6h", "1D")] == ["60", "21600", "86400"]
    for name, exchange in (("3m", "gateio"), ("1W", "okx"), ("1M", "okx"), ("30s", "okx"), ("30m", "coinbase")):
        with pytest.raises(errors.TimeframeUnsupported):
            public_interval(name, exchange)
    assert requested_limit("1m", 0, 61_000, 1000) == 2 and requested_limit("1m", 0, 10**9, 1000) == 1000 and requested_limit("1m", 5, 5, 9) == 1
    assert pages("1m", 0, 150_000, 2) == [(0, 120_000), (120_000, 150_000)]


@pytest.mark.parametrize("exchange", ["kraken", "kucoin", "gateio", "okx", "bitget", "htx"])
def test_derivative_layouts(spark, exchange):
    layout = decode.DERIVATIVE_ROWS[exchange]
    for time in (1_700_000_000,) if layout.seconds else (1_700_000_000_000, *([1_700_000_000] * layout.either)):
        values = {"time": time, "open": "1", "high": "3", "low": "1", "close": "2", "volume": "9"}
        if isinstance(layout.time, str):
            row = {getattr(layout, k): v for k, v in values.items()}
        else:
            row = [None] * 7
            for k, v in values.items():
                row[getattr(layout, k)] = v
        body = [row]
        for part in reversed(layout.path.split(".")[1:]):
            body = {part: body}
        r = decode.decode_klines(spark.createDataFrame([(json.dumps(body),)], "payload string"), exchange, "1m", derivative=True).first()
        assert (r.time, r.close, r.volume) == (1_700_000_000_000, 2, 9)


def test_recorded_payloads(spark):
    rows = [[k * 60_000, "1", "1", "1", "1", "1"] for k in range(5)]
    payload = lambda body: spark.createDataFrame([(json.dumps(body),)], "payload string")
    play = lambda body, exchange, **more: [r.time // 60_000 for r in decode.offline_klines(payload(body), exchange, "1m", 120_000, 300_000, **more).collect()]
    assert play(rows, "binance", limit=3) == [2] and play({"result": {"list": rows}}, "bybit", limit=2) == [2, 3]
    assert play(rows, "binance", server_time_ms=239_999) == [2, 3]


def test_raw_store(spark, tmp_path):
    store = RawStore(spark, f"{tmp_path}/raw")
    series = {"exchange": "binance", "symbol": "S"}
    batch = lambda *x: spark.createDataFrame([(json.dumps({"a": v}),) for v in x], "payload string")
    first = store.write(batch(1, 2), series)
    assert store.write(batch(1, 2), series) == first
    store.write(batch(3), series, partition="2024-01-01", compression="gzip")
    assert sorted(r.payload for r in store.read(series).collect()) == ['{"a": 1}', '{"a": 2}', '{"a": 3}']
    assert store.inspect().count() == 2 and store.read(series, "2024-01-01").count() == 1
    spark.createDataFrame([("{}", "binance", "S", "root", first)], "payload string, exchange string, symbol string, partition string, batch string").write.mode("append").partitionBy("exchange", "symbol", "partition", "batch").text(f"{tmp_path}/raw/lines")
    with pytest.raises(errors.ValidationError):
        store.read(series)


def test_footprint_store_keeps_other_bars(spark, tmp_path):
    store = FootprintStore(spark, f"{tmp_path}/fp")
    level = lambda time, volume: spark.createDataFrame([("binance", "spot", "S", "1h", time, 100.0, volume)], "exchange string, market string, symbol string, timeframe string, time long, price_low double, buy_volume double")
    for time, volume in ((0, 1.0), (HOUR, 2.0), (30 * HOUR, 3.0), (HOUR, 5.0)):
        store.write(level(time, volume))
    query = lambda start, end: FootprintQuery(Instrument("binance", "spot", "S"), Timeframe.parse("1h"), start, end, 10.0)
    assert [(r.time, r.buy_volume) for r in store.read(query(0, 40 * HOUR)).orderBy("time").collect()] == [(0, 1), (HOUR, 5), (30 * HOUR, 3)]
    assert store.read(query(HOUR, 2 * HOUR)).count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "good.csv").write_text("time,open,high,low,close,volume\n0,1,2,0.5,1.5,3\n120000,1,2,0.5,1.5,3\n")
    (tmp_path / "bad.csv").write_text("time,open,high,low,close\n0,5,2,0.5,1.5\n")
    assert cli.main(["validate", f"{tmp_path}/good.csv"]) == 0 and '"bars": 2' in capsys.readouterr().out
    assert cli.main(["coverage", f"{tmp_path}/good.csv"]) == 0 and '"gaps": 1' in capsys.readouterr().out
    assert cli.main(["validate", f"{tmp_path}/bad.csv"]) == 2 and "MD_VALIDATION_ERROR" in capsys.readouterr().err
    assert cli.main(["exchanges"]) == 0 and len(capsys.readouterr().out.splitlines()) == 10
    assert cli.main(["precompute", f"{tmp_path}/good.csv", f"{tmp_path}/out.parquet", "5m"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out.parquet").where(F.col("volume") == 6).count() == 1


def test_canonical_files(spark, tmp_path):
    head = "time,open,high,low,close,volume,time_close,finality,provider,provider_revision,revision_state,revision\n"
    good = "0,1,2,0.5,1.5,10,59999,FINAL,binance,repair-r1,ORIGINAL,0\n"
    read = lambda text, **more: offline.read_canonical_csv(spark, write(text), instrument=Instrument("binance", "spot", "s"), timeframe="1m", **more)

    def write(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return str(path)

    row = read(head + good).first()
    assert (row.symbol, row.close_text, row.is_closed, row.revision) == ("S", "1.5", True, 0)
    for bad in (
        "time,open\n0,1\n", head + good.replace("binance", "bybit"), head + good.replace("59999", "60000"), head + good.replace("0.5", "x"), head + good.replace("repair-r1", ""),
        head + good.replace("ORIGINAL,0", "ORIGINAL,1"), head + good.replace("FINAL", "OPEN"), head + good.replace(",2,", ",1,"), head + good + good.replace("repair-r1", "r2").replace("0,1,2", "60000,1,2").replace("59999", "119999"),
    ):
        with pytest.raises(errors.ValidationError):
            read(bad)
    assert read(head + good.replace("FINAL", "OPEN"), final_only=False).count() == 1
