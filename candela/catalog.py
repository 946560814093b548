"""Exchanges and market types as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Exchanges by rank, and the market types each lists.
EXCHANGES = {
    "binance": ("Binance", ("spot", "margin", "usdt_futures", "coin_futures", "options")),
    "bybit": ("Bybit", ("spot", "usdt_futures", "coin_futures", "options")),
    "okx": ("OKX", ("spot", "margin", "usdt_futures", "coin_futures", "delivery_futures", "options")),
    "coinbase": ("Coinbase Exchange", ("spot",)),
    "kraken": ("Kraken", ("spot", "margin", "usdt_futures", "coin_futures", "delivery_futures")),
    "kucoin": ("KuCoin", ("spot", "margin", "usdt_futures", "coin_futures")),
    "bitget": ("Bitget", ("spot", "margin", "usdt_futures", "coin_futures")),
    "gateio": ("Gate.io", ("spot", "margin", "usdt_futures", "delivery_futures", "options")),
    "htx": ("HTX / Huobi", ("spot", "margin", "usdt_futures", "coin_futures")),
    "mexc": ("MEXC", ("spot", "usdt_futures", "coin_futures")),
}
#: Names of a market type.
MARKET_TYPES = {
    "spot": ("spot", "cash"),
    "margin": ("margin", "cross-margin", "isolated-margin"),
    "usdt_futures": ("linear", "usdm", "usdt-futures", "usdc-futures", "swap"),
    "coin_futures": ("inverse", "coinm", "coin-futures", "inverse-swap"),
    "delivery_futures": ("futures", "delivery", "dated-futures"),
    "options": ("option", "options"),
}


#: Other names of an exchange.
EXCHANGE_ALIASES = {
    "binance": ("binanceusdm",),
    "bybit": ("bybit-v5",),
    "coinbase": ("coinbase-exchange", "coinbasepro"),
    "gateio": ("gate", "gate-io"),
    "htx": ("huobi",),
    "mexc": ("mexc-global",),
}


def exchanges(spark: SparkSession) -> DataFrame:
    rows = [(k, name, rank, list(kinds)) for rank, (k, (name, kinds)) in enumerate(EXCHANGES.items(), 1)]
    return spark.createDataFrame(rows, "exchange string, name string, rank int, market_types array<string>").orderBy("rank")


def market_type_aliases(spark: SparkSession) -> DataFrame:
    rows = [(alias, kind) for kind, names in MARKET_TYPES.items() for alias in {kind, *names}]
    return spark.createDataFrame(rows, "alias string, market_type string")


def _folded(name: Column, known: dict[str, str], blanks: str) -> tuple[Column, Column]:
    """The name in lower case with dashes, and what it is known as."""
    plain = F.regexp_replace(F.lower(F.trim(name)), blanks, "-")
    return plain, F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), plain)


def market_type(name: Column) -> Column:
    """The market type that a name stands for, with blanks and underscores as dashes; null if unknown."""
    return _folded(name, {alias.replace("_", "-"): kind for kind, names in MARKET_TYPES.items() for alias in (kind, *names)}, "[ _]")[1]


def exchange_id(name: Column) -> Column:
    """The id of an exchange, by its other names too; an unknown name is its own id."""
    plain, known = _folded(name, {alias: exchange for exchange, names in EXCHANGE_ALIASES.items() for alias in names}, "_")
    return F.coalesce(known, plain)
