"""Exchange payloads as bars and trades: one declarative column map per exchange, one parser for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.timeframe import canonical_column, close_time, close_time_column


@dataclass(frozen=True)
class RowMap:
    """Where an exchange's candle rows stand in its payload, the place of each field in a row, and the unit of its times."""

    path: str
    time: int | str = 0
    open: int | str = 1
    high: int | str = 2
    low: int | str = 3
    close: int | str = 4
    volume: int | str = 5
    seconds: bool = False
    either: bool = False  # seconds or milliseconds, told by size
    named: bool = False  # the rows stand under the pair's name, beside ``last``
    bare: bool = False  # the path may be left out: rows at the top


#: Layouts of public candle responses.
ROWS = {
    "binance": RowMap("$"),
    "bybit": RowMap("$.result.list"),
    "okx": RowMap("$.data"),
    "bitget": RowMap("$.data"),
    "mexc": RowMap("$"),
    "coinbase": RowMap("$", 0, 3, 2, 1, 4, 5, True),
    "kraken": RowMap("$.result", 0, 1, 2, 3, 4, 6, True, named=True),
    "kucoin": RowMap("$.data", 0, 1, 3, 4, 2, 5, True),
    "gateio": RowMap("$", 0, 5, 3, 4, 2, 1, True),
    "htx": RowMap("$.data", "id", "open", "high", "low", "close", "amount", True),
}
#: Layouts of derivative candles where they differ; mexc may send one array per field instead, see ``decode_columnar``.
DERIVATIVE_ROWS = ROWS | {
    "kraken": RowMap("$.candles", "time", "open", "high", "low", "close", "volume", either=True),
    "kucoin": RowMap("$.data", 0, 1, 2, 3, 4, 5, either=True),
    "gateio": RowMap("$.data", "t", "o", "h", "l", "c", "v", True, bare=True),
    "htx": RowMap("$.data", "id", "open", "high", "low", "close", "amount", True, bare=True),
    "mexc": RowMap("$.data", 0, 1, 2, 3, 4, 5, either=True),
}
#: Rows of derivatives that are sent as arrays where objects are usual.
DERIVATIVE_LISTS = {"gateio": RowMap("$.data", 0, 5, 3, 4, 2, 1, True, bare=True)}
_FIELDS = ("time", "open", "high", "low", "close", "volume")


def _stop(exchange: str, what: str) -> Column:
    return F.raise_error(F.lit(f"MD_INVALID_EXCHANGE_RESPONSE: {exchange} {what}"))


def _rows_text(column: Column, layout: RowMap) -> Column:
    """The rows of a payload, as JSON."""
    if layout.path == "$":
        return column
    inner = F.get_json_object(column, layout.path)
    if layout.named:
        pairs = F.map_filter(F.from_json(inner, "map<string,string>"), lambda k, v: k != "last")
        return F.coalesce(F.try_element_at(F.map_values(pairs), F.lit(1)), F.when(inner.isNotNull(), "[]"))
    return F.coalesce(inner, column) if layout.bare else inner


def decode_klines(payloads: DataFrame, exchange: str, timeframe: str, *, column: str = "payload", derivative: bool = False) -> DataFrame:
    """One row per candle of each payload, other columns kept: times in ms, prices as numbers and as the source's exact text.

    A payload without rows, and a row without time or with a price that is no number, stop the job with an MD code.
    """
    layout = (DERIVATIVE_ROWS if derivative else ROWS)[exchange]
    listed = DERIVATIVE_LISTS.get(exchange) if derivative else None
    text = _rows_text(F.col(column), layout)
    # A payload's rows are an array; from_json makes one of an object as well.
    rows = F.when(F.substring(F.ltrim(text), 1, 1) == "[", text)
    if isinstance(layout.time, str):
        item = ", ".join(f"{getattr(layout, f)} string" for f in _FIELDS)
        parsed = F.transform(F.from_json(rows, f"array<struct<{item}>>"), lambda r: F.struct(*[r[getattr(layout, f)].alias(f) for f in _FIELDS]))
        if listed:
            lists = F.transform(F.from_json(rows, "array<array<string>>"), lambda r: F.struct(*[F.get(r, F.lit(getattr(listed, f))).alias(f) for f in _FIELDS]))
            parsed = F.when(rows.rlike(r"^\s*\[\s*\["), lists).otherwise(parsed)
    else:
        parsed = F.transform(F.from_json(rows, "array<array<string>>"), lambda r: F.struct(*[F.get(r, F.lit(getattr(layout, f))).alias(f) for f in _FIELDS]))
    parsed = F.coalesce(parsed, _stop(exchange, "kline payload has no rows").cast(f"array<struct<{', '.join(f'{f}:string' for f in _FIELDS)}>>"))
    out = payloads.select("*", F.explode(parsed).alias("__row"))
    field = lambda f: F.col("__row").getField(f)
    bad = _stop(exchange, "kline row is invalid")
    number = lambda f, kind: F.coalesce(field(f).try_cast("double"), bad.cast("double")).cast(kind)
    raw = number("time", "long")
    time = raw * F.when(F.lit(layout.seconds) | (F.lit(layout.either) & (raw < 10_000_000_000)), 1000).otherwise(1)
    out = out.select(*payloads.columns, time.alias("time"), *[field(f).alias(f"{f}_text") for f in _FIELDS[1:]], *[number(f, "double").alias(f) for f in _FIELDS[1:]])
    return out.withColumn("time_close", close_time(F.col("time"), timeframe)).drop(column)


def _listed(column: str, kind: str, exchange: str, what: str) -> Column:
    """The payload as an array; one that is none, as an error message is, stops the job."""
    text = F.when(F.substring(F.ltrim(F.col(column)), 1, 1) == "[", F.col(column))
    return F.coalesce(F.from_json(text, f"array<{kind}>"), _stop(exchange, f"{what} payload has no rows").cast(f"array<{kind}>"))


def _number(text: Column, kind: str, stop: Column, *, optional: bool = False) -> Column:
    """A number of a payload; if ``optional``, null where it is left out or empty. Anything else stops the job."""
    found = F.coalesce(text.try_cast(kind), stop.cast(kind))
    return F.when(text.isNotNull() & (F.trim(text) != ""), found) if optional else found


def decode_binance(payloads: DataFrame, *, column: str = "payload", timeframe: str | None = None) -> DataFrame:
    """Rows of six to twelve fields, with their extra volumes where they have them.

    The close time is the payload's own if it lies after the open, else that of the ``timeframe``. A payload that is no array,
    a row that is too short or holds no number where one belongs, and a close time that can't be told stop the job.
    """
    stop = _stop("binance", "kline row is invalid")
    rows = payloads.select("*", F.explode(_listed(column, "array<string>", "binance", "kline")).alias("r"))
    field = lambda k: F.get("r", F.lit(k))
    rows = rows.select(
        *[c for c in payloads.columns if c != column], _number(field(0), "long", stop).alias("time"), *[_number(field(k + 1), "double", stop).alias(n) for k, n in enumerate(_FIELDS[1:])],
        _number(field(6), "long", stop, optional=True).alias("time_close"), _number(field(7), "double", stop, optional=True).alias("quote_volume"),
        _number(field(8), "long", stop, optional=True).alias("trades_count"), _number(field(9), "double", stop, optional=True).alias("taker_buy_base_volume"),
        _number(field(10), "double", stop, optional=True).alias("taker_buy_quote_volume"), *[field(k + 1).alias(f"{n}_text") for k, n in enumerate(_FIELDS[1:])],
    )
    computed = close_time(F.col("time"), timeframe) if timeframe else _stop("binance", "kline row has no close time").cast("long")
    return rows.withColumn("time_close", F.when(F.col("time_close") > F.col("time"), F.col("time_close")).otherwise(computed))


def decode_columnar(payloads: DataFrame, *, column: str = "payload", path: str = "$.data") -> DataFrame:
    """Candles sent as one array per field (times in seconds or milliseconds), zipped into rows. Fields of unequal length, or
    missing ones, stop the job."""
    names = ("time", "open", "high", "low", "close", "vol")
    kind = "struct<time:array<bigint>," + ",".join(f"{n}:array<double>" for n in names[1:]) + ">"
    data = F.from_json(F.get_json_object(column, path), kind)
    sizes = [F.coalesce(F.size(F.col("__data").getField(n)), F.lit(-1)) for n in names]
    whole = (sizes[0] >= 0) & (F.least(*sizes[1:]) >= sizes[0])
    rows = payloads.withColumn("__data", data)
    zipped = F.slice(F.arrays_zip(*[F.col("__data").getField(n).alias(n) for n in names]), F.lit(1), sizes[0])
    zipped = F.when(whole, zipped).otherwise(_stop("columnar", "kline row is invalid").cast("array<struct<" + "time:bigint," + ",".join(f"{n}:double" for n in names[1:]) + ">>"))
    rows = rows.select(*[c for c in payloads.columns if c != column], F.inline(zipped))
    time = F.col("time") * F.when(F.col("time") < 10_000_000_000, 1000).otherwise(1)
    return rows.withColumn("time", time).withColumnRenamed("vol", "volume")


def decode_trades(payloads: DataFrame, *, column: str = "payload") -> DataFrame:
    """Aggregate trades ``{a, p, q, T, m}``, those of a payload by time and id. A payload that is no array and a trade without
    one of the five, or with something else than a number, stop the job."""
    stop = _stop("binance", "aggTrade row is invalid")
    found = F.transform(
        _listed(column, "struct<a:string,p:string,q:string,T:string,m:string>", "binance", "aggTrades"),
        lambda t: F.struct(
            _number(t.getField("T"), "long", stop).alias("time"), _number(t.getField("a"), "long", stop).alias("trade_id"), _number(t.getField("p"), "double", stop).alias("price"),
            _number(t.getField("q"), "double", stop).alias("quantity"), _number(t.getField("m"), "boolean", stop).alias("buyer_maker"),
        ),
    )
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.inline(F.array_sort(found)))
    return rows.select(*[c for c in payloads.columns if c != column], "trade_id", "time", "price", "quantity", "buyer_maker")


def unique_trades(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each trade once, by its id within ``keys``: pages that overlap give a trade again. Of different rows of one id the first
    by time counts."""
    rest = [c for c in trades.columns if c not in (*keys, "trade_id", "time")]
    first = trades.groupBy(*keys, "trade_id").agg(F.min(F.struct("time", *rest)).alias("t"))
    return first.select(*keys, "trade_id", "t.*").select(*trades.columns)


#: What updates may carry beside their prices: quote and taker volumes and the number of trades, or the turnover.
_EXTRAS = {"quote_volume": "double", "trades_count": "long", "taker_buy_base_volume": "double", "taker_buy_quote_volume": "double", "turnover": "double"}


def decode_updates(events: DataFrame, *, column: str = "value", market: str = "spot") -> DataFrame:
    """Live kline events of either shape (``k`` object, or ``topic`` with ``data``), batch or stream, as one row per update.

    Prices come as numbers and as the source's exact texts, with the volumes, counts and turnover that the event has, and an id
    of the event. An event of neither shape, or without a number where one belongs, stops the job.
    """
    stop = _stop("live", "kline event is invalid")
    prices = _FIELDS[1:]
    at = lambda path: F.get_json_object(column, path)  # noqa: E731 - keys that differ in case alone are told apart by paths

    def update(exchange: str, symbol: Column, timeframe: Column, times: list[Column], values: list[Column], extras: dict[str, Column], closed: Column, event: Column, name: Column) -> Column:
        number = {"event_time": _number(event, "long", stop, optional=True), "open_time": _number(times[0], "long", stop), "close_time": _number(times[1], "long", stop, optional=True)}
        number |= {n: _number(v, "double", stop) for n, v in zip(prices, values, strict=True)}
        number |= {n: _number(extras.get(n, F.lit(None).cast("string")), k, stop, optional=True) for n, k in _EXTRAS.items()}
        text = {f"{n}_text": v for n, v in zip(prices, values, strict=True)}
        fields = {**number, **text, "raw_event_id": name, "is_closed": F.coalesce(closed.try_cast("boolean"), F.lit(False))}
        return F.struct(F.lit(exchange).alias("exchange"), F.upper(symbol).alias("symbol"), timeframe.alias("timeframe"), *[v.alias(n) for n, v in fields.items()])

    one = F.array(update(
        "binance", F.coalesce(at("$.k.s"), at("$.s")), F.coalesce(at("$.k.i"), F.lit("1m")), [at("$.k.t"), at("$.k.T")], [at(f"$.k.{x}") for x in "ohlcv"],
        {"quote_volume": at("$.k.q"), "trades_count": at("$.k.n"), "taker_buy_base_volume": at("$.k.V"), "taker_buy_quote_volume": at("$.k.Q")}, at("$.k.x"), at("$.E"),
        F.concat(F.coalesce(at("$.e"), F.lit("kline")), F.lit(":"), F.coalesce(at("$.E"), F.lit(""))),
    ))
    topic = F.split(at("$.topic"), r"\.")
    item = ",".join(f"{n}:string" for n in ("start", "end", *prices, "turnover", "confirm", "timestamp"))
    data = F.from_json(F.when(F.substring(F.ltrim(at("$.data")), 1, 1) == "[", at("$.data")), f"array<struct<{item}>>")
    interval = F.get(topic, F.lit(1))
    minutes = canonical_column(F.when(interval.rlike("^[0-9]+$") & (interval.try_cast("int") % 60 == 0), F.concat((interval.try_cast("int") / 60).cast("int").cast("string"), F.lit("h"))).otherwise(interval))
    many = F.transform(data, lambda x: update(
        "bybit", F.get(topic, F.lit(2)), minutes, [x.getField("start"), x.getField("end")], [x.getField(p) for p in prices], {"turnover": x.getField("turnover")}, x.getField("confirm"),
        F.coalesce(x.getField("timestamp"), at("$.ts")), F.concat(at("$.topic"), F.lit(":"), F.coalesce(at("$.ts"), F.lit(""))),
    ))
    shaped = F.when(at("$.k").isNotNull(), one).when(at("$.topic").isNotNull(), many)
    none = F.array_repeat(F.get(one, F.lit(0)), stop.cast("int"))  # of the same type; its length can't be told, which stops the job
    rows = events.select(F.lit(market).alias("market"), F.inline(F.coalesce(shaped, none)))
    return rows.withColumn("close_time", F.coalesce("close_time", close_time_column(F.col("open_time"), F.col("timeframe"))))


def offline_klines(payloads: DataFrame, exchange: str, timeframe: str, start_ms: int, end_ms: int, *, limit: int | None = None, server_time_ms: int | None = None) -> DataFrame:
    """Recorded payloads played back: closed candles of the range by time. Binance counts its limit before the range, Bybit after."""
    rows = decode_klines(payloads, exchange, timeframe)
    if server_time_ms is not None:
        rows = rows.where(F.col("time_close") <= server_time_ms)
    inside = (F.col("time") >= start_ms) & (F.col("time") < end_ms)
    if limit is None:
        return rows.where(inside).orderBy("time")
    return rows.orderBy("time").limit(limit).where(inside) if exchange == "binance" else rows.where(inside).orderBy("time").limit(limit)
