"""The engine as one object, results of writes, the command line, and texts that name streams and artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from candela import cli, errors
from candela.engine import Engine
from candela.functions import identity
from candela.functions.timeframe import Timeframe
from candela.plans.query import BarQuery, FootprintQuery, Instrument
from candela.sources import recorded
from candela.store import RawStore

MINUTE, HOUR = 60_000, 3_600_000
NAME = Instrument("okx", "spot", "A/B")


def bars(spark, times, close=1.5, closed=True, high=2.0):
    rows = [("okx", "spot", "A/B", "1m", t * MINUTE, 1.0, high, 0.5, close, 3.0, (t + 1) * MINUTE - 1, closed) for t in times]
    return spark.createDataFrame(rows, "exchange string, market string, symbol string, timeframe string, time long, open double, high double, low double, close double, volume double, time_close long, is_closed boolean")


def test_writes_end_in_results(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/e")
    assert engine.save(bars(spark, range(3))).value == {"new": 3, "duplicate": 0}
    assert engine.save(bars(spark, range(2, 5))).value == {"new": 2, "duplicate": 1}
    clash = engine.save(bars(spark, [1], close=1.7))
    assert (clash.ok, clash.code) == (False, "MD_CACHE_CONFLICT") and clash.message
    assert engine.save(bars(spark, [9], closed=False)).code == "MD_VALIDATION_ERROR"
    assert engine.save(bars(spark, [9], high=0.1)).code == "MD_VALIDATION_ERROR"
    assert engine.append(bars(spark, [2])).ok is False and engine.append(bars(spark, [5])).ok
    assert engine.repair(bars(spark, [1], close=1.7)).ok
    assert [r.close for r in engine.store.read_all().orderBy("time").collect()] == [1.5, 1.7, 1.5, 1.5, 1.5, 1.5]
    with pytest.raises(Exception, match="nonesuch"):
        engine.save(bars(spark, [7]).withColumn("close", F.expr("cast(java_method('nonesuch', 'x') as double)")))


def test_bars_are_completed_and_kept(spark, tmp_path):
    asked = []

    def source(query):
        asked.append((query.start_ms // MINUTE, query.end_ms // MINUTE))
        return bars(spark, range(*asked[-1]))

    engine = Engine(spark, f"{tmp_path}/e", rest=source)
    engine.save(bars(spark, range(10)))
    query = BarQuery(NAME, Timeframe.parse("1m"), 0, 20 * MINUTE)
    assert engine.bars(query, HOUR).count() == 20 and asked == [(10, 20)]
    assert engine.bars(query, HOUR).count() == 20 and len(asked) == 1
    with pytest.raises(errors.ContractError):
        Engine(spark, f"{tmp_path}/e").bars(query, HOUR)
    with pytest.raises(errors.ContractError):
        engine.footprint(FootprintQuery(NAME, Timeframe.parse("1h"), 0, HOUR, 1.0))


def test_stream_names(spark):
    row = spark.createDataFrame([("BtcUsdt",)], "s string")
    one = lambda exchange, market, timeframe: row.select(identity.kline_stream(exchange, F.lit(market), F.col("s"), timeframe).alias("x")).first().x
    assert one("binance", "spot", "1m").topic == "btcusdt@kline_1m" and one("binance", "usdm", "1D").url.endswith("/ws/btcusdt@kline_1d")
    found = one("bybit", "linear", "4h")
    assert found.topic == "kline.240.BTCUSDT" and json.loads(found.subscribe) == {"op": "subscribe", "args": ["kline.240.BTCUSDT"]}
    assert one("bybit", "spot", "1W").topic == "kline.W.BTCUSDT" and one("binance", None, "1m") is None
    with pytest.raises(errors.SymbolUnsupported), errors.from_jobs():
        one("bybit", "option", "1m")
    with pytest.raises(errors.UnsupportedFeature):
        one("okx", "spot", "1m")
    rows = spark.createDataFrame([("BTC_USD", "inverse"), ("ETH-USD", "inverse"), ("BTC_USDT", "inverse"), ("X_Y", "linear"), ("_USD", "inverse"), (None, "inverse")], "s string, m string")
    assert [r[0] for r in rows.select(identity.settlement(F.col("s"), F.col("m"))).collect()] == ["btc", "eth", "usdt", "usdt", "btc", "btc"]


def test_artifacts_are_named_exactly(spark):
    good, stack = "0f" * 20, "sha256:" + "a1" * 32
    rows = [(good, stack), ("0" * 40, stack), (good, "sha256:" + "0" * 64), (good.upper(), stack), (good + "\n", stack), (good, stack[7:]), (None, stack), (good, None), (good[:-1], stack)]
    found = spark.createDataFrame(rows, "c string, s string").select(identity.artifact_known(F.col("c"), F.col("s")))
    assert [r[0] for r in found.collect()] == [True] + [False] * 8


def test_raw_batches_are_named_by_content(spark, tmp_path):
    store, series = RawStore(spark, f"{tmp_path}/raw"), {"symbol": "S"}
    batch = lambda *x: spark.createDataFrame([(v,) for v in x], "payload string").repartition(3)
    first = store.write(batch("a", "b", "b"), series)
    assert len(first) == 64 and store.write(batch("b", "a", "b"), series) == first
    assert len({first, store.write(batch("a", "b"), series), store.write(batch("a", "a", "b"), series), store.write(batch(), series)}) == 4


def test_commands(spark, tmp_path, capsys):
    def ran(*arguments):
        code = cli.main([str(a) for a in arguments])
        out = capsys.readouterr()
        return code, [json.loads(x) for x in (out.out or out.err).splitlines() if x.startswith("{")]

    assert ran("ws-info", "bybit", "spot", "btcusdt", "--timeframe", "1h")[1][0]["topic"] == "kline.60.BTCUSDT"
    code, found = ran("ws-info", "bybit", "option", "btcusdt")
    assert code == 2 and found[0]["error"] == "MD_SYMBOL_UNSUPPORTED" and "no market option" in found[0]["message"]
    recorded.register(spark)
    rows = [[str(t), "1", "2", "0.5", "1.5", "3"] for t in range(0, 10 * HOUR, HOUR)]
    page = [("okx", "spot", "AB", "1h", 0, 10 * HOUR, json.dumps({"data": rows}))]
    recorded.record(spark.createDataFrame(page, "exchange string, market string, symbol string, timeframe string, start long, end long, payload string"), f"{tmp_path}/recorded")
    code, found = ran("fetch", tmp_path / "e", f"{tmp_path}/recorded", "okx/spot/AB", 2 * HOUR, 5 * HOUR, "--timeframe", "1h")
    assert code == 0 and [r["time"] // HOUR for r in found] == [2, 3, 4]
    assert len(ran("manifest", tmp_path / "e" / "bars")[1]) == 1
    event = {"e": "kline", "E": 5, "s": "BTCUSDT", "k": {"s": "BTCUSDT", "i": "1m", "t": 0, "T": 59999, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "n": 3, "x": True}}
    (tmp_path / "updates").mkdir()
    (tmp_path / "updates" / "a.json").write_text(json.dumps(event) + "\n")
    assert ran("checkpoints", tmp_path / "updates")[1][0]["symbol"] == "BTCUSDT"
    code, found = ran("stream", tmp_path / "live", tmp_path / "updates")
    assert code == 0 and found[-1]["ok"] and found[-1]["outcomes"]["committed"] == 1
    Engine(spark, f"{tmp_path}/live").repair(Engine(spark, f"{tmp_path}/live").store.read_all())
    assert ran("repair-logs", tmp_path / "live" / "bars")[0] == 0
    RawStore(spark, f"{tmp_path}/raw").write(spark.createDataFrame([("x",)], "payload string"), {"symbol": "S"})
    assert ran("raw-inspect", tmp_path / "raw")[1][0]["rows_count"] == 1
