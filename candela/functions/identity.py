"""Instruments and symbols: normalised names, quote assets, path parts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.errors import UnsupportedFeature
from candela.functions.timeframe import interval_name

#: Exchanges whose symbols are understood.
EXCHANGES = ("BINANCE", "BYBIT", "OKX", "COINBASE", "KRAKEN", "KUCOIN", "BITGET", "GATEIO", "HTX", "MEXC")
#: Stable quote assets.
STABLE_QUOTES = ("USDT", "USDC", "FDUSD", "BUSD", "TUSD", "USDP", "DAI", "USD", "EUR")
#: Market aliases. Dashes count as underscores.
SPOT = ("spot", "cash")
LINEAR = ("linear", "usdm", "futures", "usdt_futures", "usdc_futures", "swap")
INVERSE = ("inverse", "coinm", "coin_futures", "delivery")
DELIVERY = ("delivery_futures", "dated_futures")
DERIVATIVES = ("usdm", "linear", "coinm", "inverse")


def market_aliases(exchange: str) -> dict[str, str]:
    """What each market name means at an exchange."""
    if exchange == "COINBASE":
        return dict.fromkeys(SPOT, "spot")
    if exchange in ("BINANCE", "BYBIT"):
        linear, inverse = ("usdm", "coinm") if exchange == "BINANCE" else ("linear", "inverse")
        spot = dict.fromkeys((*SPOT, "margin") if exchange == "BINANCE" else ("spot", "margin"), "spot")
        return spot | dict.fromkeys(LINEAR, linear) | dict.fromkeys((*INVERSE, "delivery_futures"), inverse)
    own = dict.fromkeys(SPOT, "spot") | dict.fromkeys(LINEAR, "linear") | dict.fromkeys(INVERSE, "inverse") | dict.fromkeys(DELIVERY, "delivery_futures")
    return own if exchange == "MEXC" else own | {"margin": "margin"}


def provider_market(exchange: Column, market: Column) -> Column:
    """The market's name at the exchange; null if it has none."""
    known = {f"{e}/{alias}": name for e in EXCHANGES for alias, name in market_aliases(e).items()}
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    name = F.regexp_replace(F.lower(F.trim(market)), "[ -]", "_")
    return F.try_element_at(table, F.concat_ws("/", F.upper(exchange), name))


def quote_asset(symbol: Column, quotes: Sequence[str] = STABLE_QUOTES) -> Column:
    """The longest quote asset that ends the symbol (before any ``_``), or null."""
    raw = F.upper(F.trim(symbol))
    raw = F.regexp_replace(raw, "^[^:]*:", "")
    root = F.split_part(F.regexp_replace(raw, r"\.P$", ""), F.lit("_"), F.lit(1))
    found = F.lit(None).cast("string")
    for quote in sorted((q.upper() for q in quotes), key=len):
        found = F.when(root.endswith(quote), F.lit(quote)).otherwise(found)
    return found


def normalised_symbol(symbol: Column, exchange: Column | None = None, market: Column | None = None) -> Column:
    """``exchange, market, base, quote, tv_symbol, exchange_symbol, is_perpetual, error`` of ``[EXCHANGE:]SYMBOL[.P]``."""
    raw = F.upper(F.trim(symbol))
    named = F.instr(raw, ":") > 0
    prefix = F.when(named, F.split_part(raw, F.lit(":"), F.lit(1)))
    rest = F.when(named, F.regexp_replace(raw, "^[^:]*:", "")).otherwise(raw)
    ex = F.coalesce(F.nullif(F.upper(exchange), F.lit("")), prefix) if exchange is not None else prefix
    perpetual = rest.endswith(".P")
    contract = F.regexp_replace(rest, r"\.P$", "")
    own = F.when(perpetual, F.when(ex == "BINANCE", "usdm").otherwise("linear")).otherwise("spot")
    asked = F.nullif(F.trim(market), F.lit("")) if market is not None else F.lit(None).cast("string")
    place = F.when(asked.isNotNull(), provider_market(ex, asked)).otherwise(own)
    quote = quote_asset(contract)
    base = F.when(quote.isNotNull(), F.substr(contract, F.lit(1), F.length(contract) - F.length(quote))).otherwise(contract)
    derived = place.isin(*DERIVATIVES)
    error = (
        F.when(F.coalesce(raw, F.lit("")) == "", "MD_SYMBOL_UNSUPPORTED")
        .when(named & ~prefix.isin(*EXCHANGES), "MD_SYMBOL_UNSUPPORTED")
        .when(ex.isNull(), "MD_SYMBOL_AMBIGUOUS")
        .when(~ex.isin(*EXCHANGES) | place.isNull(), "MD_SYMBOL_UNSUPPORTED")
    )
    return F.struct(
        F.lower(ex).alias("exchange"), place.alias("market"), base.alias("base"), quote.alias("quote"),
        F.concat(ex, F.lit(":"), contract, F.when(perpetual | derived, ".P").otherwise("")).alias("tv_symbol"),
        contract.alias("exchange_symbol"), derived.alias("is_perpetual"), error.alias("error"),
    )


def instrument_id(exchange: Column, market: Column, symbol: Column) -> Column:
    return F.concat_ws("/", F.lower(F.trim(exchange)), F.lower(F.trim(market)), F.upper(F.trim(symbol)))


def parsed_instrument(text: Column) -> Column:
    """The three parts of an instrument id, or null if there aren't three non-empty ones."""
    parts = F.split(text, "/", -1)
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda x: F.trim(x) == "")
    return F.when(good, F.struct(F.lower(F.trim(parts[0])).alias("exchange"), F.lower(F.trim(parts[1])).alias("market"), F.upper(F.trim(parts[2])).alias("symbol")))


def safe_path_part(text: Column) -> Column:
    cleaned = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^[._]+|[._]+$", ""), F.lit("")), F.lit("UNKNOWN"))


def parsed_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "1.0", "yes", "y")


def settlement(symbol: Column, market: Column) -> Column:
    """The currency in which a contract is settled, as one exchange's requests name it: usdt, or a coin-margined one's own coin."""
    raw = F.upper(F.trim(symbol))
    base = F.split_part(F.split_part(raw, F.lit("_"), F.lit(1)), F.lit("-"), F.lit(1))
    return F.when((F.lower(market) == "linear") | F.contains(raw, F.lit("USDT")), "usdt").otherwise(F.coalesce(F.nullif(F.lower(base), F.lit("")), F.lit("btc")))


#: Where the candle streams of an exchange's markets are.
STREAMS = {
    ("binance", "spot"): "wss://stream.binance.com:9443/ws",
    ("binance", "usdm"): "wss://fstream.binancefuture.com/ws",
    ("bybit", "spot"): "wss://stream.bybit.com/v5/public/spot",
    ("bybit", "linear"): "wss://stream.bybit.com/v5/public/linear",
}


def kline_stream(exchange: str, market: Column, symbol: Column, timeframe: str) -> Column:
    """``url, topic, subscribe`` of a symbol's live candles; ``subscribe`` is the message to send, null where the url says all.

    A market that the exchange doesn't stream stops the job with ``MD_SYMBOL_UNSUPPORTED``; null in, null out.
    """
    bases = {m: url for (e, m), url in STREAMS.items() if e == exchange}
    if not bases:
        raise UnsupportedFeature(f"no candle stream of {exchange}")
    name = interval_name(timeframe, exchange)
    known = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(bases.items())]), market)
    base = F.coalesce(known, F.raise_error(F.concat(F.lit(f"MD_SYMBOL_UNSUPPORTED: {exchange} streams no market "), market)).cast("string"))
    if exchange == "binance":
        topic = F.concat(F.lower(symbol), F.lit(f"@kline_{name}"))
        url, message = F.concat_ws("/", base, topic), F.lit(None).cast("string")
    else:
        topic = F.concat(F.lit(f"kline.{name}."), F.upper(symbol))
        url, message = base, F.to_json(F.struct(F.lit("subscribe").alias("op"), F.array(topic).alias("args")))
    return F.when(market.isNotNull() & symbol.isNotNull(), F.struct(url.alias("url"), topic.alias("topic"), message.alias("subscribe")))


def artifact_known(producer_commit: Column, stack_id: Column) -> Column:
    """Whether a snapshot's producer is named exactly: a full commit hash and a ``sha256:`` hash, in small letters, neither all zeros."""
    commit = producer_commit.rlike(r"^[0-9a-f]{40}\z") & ~producer_commit.rlike("^0+$")
    stack = stack_id.rlike(r"^sha256:[0-9a-f]{64}\z") & ~stack_id.rlike("^sha256:0+$")
    return F.coalesce(commit & stack, F.lit(False))
