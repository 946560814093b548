"""Hand-written payloads: rows that are right, short, bent or none at all."""

import json

import pytest

from candela.sources import decode


def frame(spark, *bodies, column="payload"):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], f"{column} string")


def stops(rows, text="MD_INVALID_EXCHANGE_RESPONSE"):
    with pytest.raises(Exception, match=text):
        rows.collect()


def test_binance_rows(spark):
    full = [60_000, "1.10", "2", "0.5", "1.5", "3", 119_999, "4.5", 7, "1", "2", "0"]
    found = decode.decode_binance(frame(spark, [full, [0, "1", "2", "0.5", "1.5", "3"], [0, 1, 2, 0.5, 1.5, 3, 0, "", None]]), timeframe="1m").collect()
    assert [(r.time, r.time_close, r.open_text, r.quote_volume, r.trades_count, r.taker_buy_quote_volume) for r in found] == [
        (60_000, 119_999, "1.10", 4.5, 7, 2.0), (0, 59_999, "1", None, None, None), (0, 59_999, "1", None, None, None),
    ]
    assert decode.decode_binance(frame(spark, [full])).first().time_close == 119_999 and decode.decode_binance(frame(spark, [])).count() == 0
    for bad in ({"code": -1}, "oops", [[0, "1", "2", "0.5", "1.5"]], [[0, "1", "x", "0.5", "1.5", "3"]], [[None, "1", "2", "0.5", "1.5", "3"]], [[*full[:8], "many"]], [5]):
        stops(decode.decode_binance(frame(spark, bad), timeframe="1m"))
    stops(decode.decode_binance(frame(spark, [full[:6]])))  # no close time and no timeframe to tell it


def test_aggregate_trades(spark):
    trade = lambda a, t, **more: {"a": a, "T": t, "p": "1.5", "q": "2", "m": True, **more}
    rows = decode.decode_trades(frame(spark, [trade(3, 20), trade(2, 20), trade(1, 30, m=False), trade(2, 20)]))
    assert [(r.trade_id, r.time, r.price, r.buyer_maker) for r in rows.collect()] == [(2, 20, 1.5, True), (2, 20, 1.5, True), (3, 20, 1.5, True), (1, 30, 1.5, False)]
    assert sorted(r.trade_id for r in decode.unique_trades(rows).collect()) == [1, 2, 3] and decode.unique_trades(rows).columns == rows.columns
    for bad in ({"code": -1}, [trade(1, 2, p="x")], [{"a": 1, "T": 2, "p": "1", "q": "1"}], [trade(None, 2)], [7]):
        stops(decode.decode_trades(frame(spark, bad)))


def test_live_events(spark):
    k = {"t": 0, "T": 59_999, "s": "btcusdt", "i": "1m", "o": "1.10", "h": "2", "l": "1", "c": "1.5", "v": "3", "x": True, "q": "4.5", "n": 7, "V": "1", "Q": "2"}
    item = {"start": 0, "end": 3_599_999, "open": "1.10", "high": "2", "low": "1", "close": "1.5", "volume": "3", "turnover": "4", "confirm": False, "timestamp": 5}
    events = frame(spark, {"e": "kline", "E": 9, "k": k}, {"topic": "kline.60.ethusdt", "ts": 7, "data": [item, {x: v for x, v in item.items() if x not in ("end", "timestamp", "turnover")}]}, column="value")
    a, b, c = decode.decode_updates(events).orderBy("exchange", "event_time").collect()
    assert (a.symbol, a.timeframe, a.event_time, a.close_time, a.open_text, a.quote_volume, a.trades_count, a.taker_buy_base_volume, a.taker_buy_quote_volume, a.turnover, a.is_closed, a.raw_event_id) == (
        "BTCUSDT", "1m", 9, 59_999, "1.10", 4.5, 7, 1.0, 2.0, None, True, "kline:9")
    assert (b.symbol, b.timeframe, b.event_time, b.turnover, b.quote_volume, b.is_closed, b.raw_event_id) == ("ETHUSDT", "1h", 5, 4.0, None, False, "kline.60.ethusdt:7")
    assert (c.event_time, c.close_time, c.turnover) == (7, 3_599_999, None)
    for bad in ({"result": None}, "{", {"k": {**k, "c": "x"}}, {"k": {"t": 0}}, {"topic": "kline.1.X", "data": {"start": 0}}, {"topic": "kline.1.X", "data": [{**item, "open": None}]}):
        stops(decode.decode_updates(frame(spark, bad, column="value")))
    assert decode.decode_updates(frame(spark, {"topic": "kline.1.X", "data": []}, column="value")).count() == 0
