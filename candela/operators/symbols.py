"""Symbol catalogues: decoding, tradability, search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.errors import UnsupportedFeature
from candela.functions.identity import STABLE_QUOTES, normalised_symbol, quote_asset

#: Statuses that mean a symbol can't be traded.
DISABLED = ("BREAK", "DISABLED", "OFFLINE", "SETTLED", "SUSPENDED", "HALT", "CANCEL_ONLY")


def disabled(status: Column) -> Column:
    """Whether a status bars trading; none doesn't."""
    return F.upper(F.trim(F.coalesce(status.cast("string"), F.lit("")))).isin(*DISABLED)


def asset(name: Column) -> Column:
    upper = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(upper == "XBT", "BTC").otherwise(upper)


@dataclass(frozen=True)
class Catalogue:
    """Where an exchange's symbols stand in its payload, and the fields of each."""

    path: str
    symbol: str
    base: str
    quote: str
    live: Callable[[], Column]
    named: bool = False  # the symbols stand under their names
    market: Callable[[], Column] | None = None  # of a contract, told by its fields
    other: str | None = None  # a second name's field
    delimited: bool = False  # base and quote may be told by the symbol's parts


def _is(name: str, *values: str) -> Callable[[], Column]:
    return lambda: F.lower(F.coalesce(name, F.lit(""))).isin("", *values)


def _open(name: str, flag: str | None = None, closed: str = "false") -> Callable[[], Column]:
    """The status isn't one that bars trading, and the flag doesn't say so either."""
    return lambda: ~disabled(F.col(name)) & (~F.col(flag).eqNullSafe(closed) if flag else F.lit(True))


def _kraken_market() -> Column:
    inverse = (F.lower("type") == "futures_inverse") | F.upper("symbol").startswith("PI_")
    return F.when(F.upper("symbol").rlike("^(FF|FI)_"), "delivery_futures").when(inverse, "inverse").otherwise("linear")


def _kucoin_market() -> Column:
    dated = ~F.coalesce("expireDate", F.lit("")).isin("", "0")
    return F.when(dated, "delivery_futures").when(F.col("isInverse") == "true", "inverse").otherwise("linear")


#: Fields of public symbol catalogues, of spot markets and of contracts.
SPOT = {
    "binance": Catalogue("$.symbols", "symbol", "baseAsset", "quoteAsset", lambda: F.col("status") == "TRADING"),
    "bybit": Catalogue("$.result.list", "symbol", "baseCoin", "quoteCoin", lambda: F.col("status") == "Trading"),
    "okx": Catalogue("$.data", "instId", "baseCcy", "quoteCcy", _is("state", "live")),
    "coinbase": Catalogue("$", "id", "base_currency", "quote_currency", _open("status", "trading_disabled", "true")),
    "kraken": Catalogue("$.result", "altname", "base", "quote", _open("status"), named=True, other="wsname"),
    "kucoin": Catalogue("$.data", "symbol", "baseCurrency", "quoteCurrency", _open("status", "enableTrading")),
    "bitget": Catalogue("$.data", "symbol", "baseCoin", "quoteCoin", _open("status")),
    "gateio": Catalogue("$", "id", "base", "quote", _is("trade_status", "tradable")),
    "htx": Catalogue("$.data", "sc", "bcdn", "qcdn", _is("state", "online")),
    "mexc": Catalogue("$.symbols", "symbol", "baseAsset", "quoteAsset", _open("status")),
}
CONTRACTS = {
    "okx": Catalogue("$.data", "instId", "baseCcy", "quoteCcy", _is("state", "live"), market=lambda: F.lower("ctType"), delimited=True),
    "kraken": Catalogue("$.instruments", "symbol", "base", "quote", _open("status", "tradeable"), market=_kraken_market),
    "kucoin": Catalogue("$.data", "symbol", "baseCurrency", "quoteCurrency", _open("status"), market=_kucoin_market),
    "bitget": Catalogue("$.data", "symbol", "baseCoin", "quoteCoin", _open("status")),
    "gateio": Catalogue("$", "name", "base", "quote", _open("trade_status", "in_delisting", "true"), delimited=True),
    "htx": Catalogue("$.data", "contract_code", "symbol", "trade_partition", _open("contract_status"), delimited=True),
    "mexc": Catalogue("$.data", "symbol", "baseCoin", "quoteCoin", lambda: F.coalesce("state", F.lit("")).isin("", "0") & ~F.col("apiAllowed").eqNullSafe("false"),
                      market=lambda: F.when(F.upper("settleCoin").isin("USDT", "USDC"), "linear").otherwise("inverse"), delimited=True),
}
#: Every field that a rule above looks at.
_FLAGS = (
    "state", "status", "trading_disabled", "enableTrading", "trade_status", "ctType", "type", "tradeable", "isInverse", "expireDate", "in_delisting", "contract_status",
    "settleCoin", "settleCcy", "apiAllowed", "wsname", "instFamily", "id",
)


def normalise_symbols(rows: DataFrame, exchange: str, market: str | None = None, *, column: str = "symbol") -> DataFrame:
    """The parts of each symbol beside the other columns."""
    parts = normalised_symbol(F.col(column), F.lit(exchange), F.lit(market) if market else None)
    return rows.withColumn("__parts", parts).select(*[c for c in rows.columns if c != "exchange"], "__parts.*")


def search_symbols(
    rows: DataFrame, query: str = "", *, stable_only: bool = True, quotes: Sequence[str] = STABLE_QUOTES, limit: int | None = 50, order: str = "symbol", column: str = "symbol",
) -> DataFrame:
    """Symbols with a stable quote whose name, base or quote holds the query; the first ``limit`` by ``order``."""
    quote = quote_asset(F.col(column), quotes)
    root = F.regexp_replace(F.upper(F.trim(column)), r"\.P$", "")
    base = F.when(quote.isNotNull(), F.substr(root, F.lit(1), F.length(root) - F.length(quote))).otherwise(root)
    wanted = query.strip().upper()
    out = rows.withColumns({"base": base, "quote": quote})
    if stable_only:
        out = out.where("quote IS NOT NULL")
    if wanted:
        out = out.where(F.upper(column).contains(wanted) | F.col("base").contains(wanted) | F.col("quote").contains(wanted))
    return out if limit is None else out.orderBy(order).limit(limit)


def tradable(rows: DataFrame, *, column: str = "status") -> DataFrame:
    """Rows whose status doesn't bar trading; one without a status is kept."""
    return rows.where(~disabled(F.col(column)))


def decode_catalogue(payloads: DataFrame, exchange: str, *, market: str = "spot", column: str = "payload") -> DataFrame:
    """Symbols that trade, of an exchange's public catalogue: ``exchange, market, symbol, base, quote``.

    ``market`` is spot, margin, or a kind of contract; contracts of another kind are left out. XBT counts as BTC. Where base or
    quote isn't given, it is told by the symbol's stable quote or by its parts; symbols that stay without are left out.
    """
    spot = market in ("spot", "margin")
    known = SPOT if spot else CONTRACTS
    if exchange not in known:
        raise UnsupportedFeature(f"no {market} catalogue of {exchange}")
    c = known[exchange]
    text = F.get_json_object(column, c.path) if c.path != "$" else F.col(column)
    fields = dict.fromkeys([c.symbol, c.base, c.quote, *_FLAGS])
    kind = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"
    items = F.map_values(F.from_json(text, f"map<string,{kind}>")) if c.named else F.from_json(text, f"array<{kind}>")
    rows = payloads.select(F.explode(items).alias("s")).where("s IS NOT NULL").select("s.*").where(c.live())
    if c.market is not None and not spot:
        found = F.coalesce(c.market(), F.lit(""))
        rows = rows.where((found == market) | (found == "") if exchange == "okx" else found == market)
    symbol = F.upper(F.trim(F.coalesce(c.symbol, "id"))) if exchange == "gateio" else F.upper(F.trim(c.symbol))
    base, quote = asset(F.col(c.base)), asset(F.col(c.quote))
    if c.other:
        pair = F.split(c.other, "/")
        base, quote = (F.when(F.contains(c.other, F.lit("/")), asset(F.get(pair, F.lit(k)))).otherwise(x) for k, x in ((0, base), (1, quote)))
    if exchange == "okx" and not spot:
        quote = F.when(quote == "", asset(F.col("settleCcy"))).otherwise(quote)
    quote = F.when(quote == "", F.coalesce(quote_asset(symbol), F.lit(""))).otherwise(quote)
    base = F.when((base == "") & (quote != "") & F.endswith(symbol, quote), F.substr(symbol, F.lit(1), F.length(symbol) - F.length(quote))).otherwise(base)
    if c.delimited:
        parts = F.split(F.coalesce(F.upper("instFamily"), symbol) if exchange == "okx" else symbol, "[_-]")
        lacking = (base == "") | (quote == "")
        base, quote = (F.when(lacking, F.coalesce(F.get(parts, F.lit(k)), F.lit(""))).otherwise(x) for k, x in ((0, base), (1, quote)))
    named = rows.select(F.lit(exchange).alias("exchange"), F.lit(market).alias("market"), symbol.alias("symbol"), base.alias("base"), quote.alias("quote"))
    return named.where("symbol != '' AND base != '' AND quote != ''")


def query_base(query: Column) -> Column:
    """The base asset that a search text names: what stands before a delimiter or a stable quote."""
    plain = F.regexp_replace(F.upper(F.trim(query)), "[/_]", "-")
    quote = quote_asset(plain)
    cut = F.when(F.length(plain) > F.length(quote), F.substr(plain, F.lit(1), F.length(plain) - F.length(quote)))
    return F.when(F.contains(plain, F.lit("-")), F.split(plain, "-")[0]).otherwise(F.coalesce(cut, plain))


def candidate_symbol(exchange: str, base: Column, quote: Column) -> Column:
    """How an exchange writes a spot pair."""
    between = {"coinbase": "-", "okx": "-", "kucoin": "-", "gateio": "_"}.get(exchange, "")
    return F.concat(base, F.lit(between), quote)
