"""Column layouts of bars, trades and footprints."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"long": LongType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType()}


def struct(text: str) -> StructType:
    """Columns from ``name type, ...`` without a session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


#: What identifies a series, apart from its timeframe.
INSTRUMENT = ("exchange", "market", "symbol")

BARS = struct(
    "time long, open double, high double, low double, close double, volume double, time_close long, exchange string, market string, symbol string,"
    " timeframe string, quote_volume double, turnover double, trades_count long, taker_buy_base_volume double, taker_buy_quote_volume double,"
    " source_transport string, source_kind string, is_closed boolean, provider string, provider_revision string, revision_state string, revision long,"
    " open_text string, high_text string, low_text string, close_text string, volume_text string, downloaded_at long"
)
#: Equal in these means the same candle; transport, download time and provenance may differ.
CANDLE = tuple(
    f.name for f in BARS if f.name not in ("source_transport", "downloaded_at", "provider", "provider_revision", "revision_state", "revision")
)
TRADES = struct("trade_id long, time long, price double, quantity double, buyer_maker boolean")
FOOTPRINT = struct(
    "time long, time_close long, price_low double, price_high double, buy_volume double, sell_volume double, buy_count long, sell_count long, trades_count long"
)
