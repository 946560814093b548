"""Volume footprints: traded volume by bar, price level and side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.hashing import digest, folded
from candela.functions.timeframe import bucket, milliseconds


def footprint_levels(trades: DataFrame, timeframe: str, price_bucket: float, *, keys: Sequence[str] = ("symbol",), start: int | None = None) -> DataFrame:
    """One row per bar and price level; a trade whose buyer was the maker is a sale. Bars before ``start`` are left out."""
    length = milliseconds(timeframe)
    step = F.lit(float(price_bucket))
    at = bucket(F.col("time"), timeframe)
    rows = trades if start is None else trades.where(F.col("time") >= start)
    sold = F.col("buyer_maker")
    amount = F.col("quantity").cast("decimal(38,18)")
    levels = rows.groupBy(*keys, at.alias("bar_time"), (F.floor(F.col("price") / step) * step).alias("price_low")).agg(
        F.coalesce(F.sum(F.when(~sold, amount)), F.lit(0)).cast("double").alias("buy_volume"),
        F.coalesce(F.sum(F.when(sold, amount)), F.lit(0)).cast("double").alias("sell_volume"),
        F.count_if(~sold).alias("buy_count"),
        F.count_if(sold).alias("sell_count"),
    )
    levels = levels if start is None else levels.where(F.col("bar_time") >= start)
    return levels.select(
        *keys, F.col("bar_time").alias("time"), (F.col("bar_time") + length).alias("time_close"), "price_low", (F.col("price_low") + step).alias("price_high"),
        "buy_volume", "sell_volume", "buy_count", "sell_count", (F.col("buy_volume") + F.col("sell_volume")).alias("total_volume"),
        (F.col("buy_volume") - F.col("sell_volume")).alias("volume_delta"),
    )


def footprint_bars(levels: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Totals per bar, and its levels in order of price (as many as the bar's price range has buckets)."""
    fields = ("price_low", "price_high", "buy_volume", "sell_volume", "buy_count", "sell_count")
    return levels.groupBy(*keys, "time", "time_close").agg(
        F.sum(F.col("buy_count") + F.col("sell_count")).alias("trades_count"),
        F.sum(F.col("buy_volume").cast("decimal(38,18)")).cast("double").alias("buy_volume"),
        F.sum(F.col("sell_volume").cast("decimal(38,18)")).cast("double").alias("sell_volume"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("levels"),
    )


def flat(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Nested bars as rows per level again."""
    return bars.select(*keys, "time", "time_close", "trades_count", F.inline("levels"))


def footprint_checksum(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series a hash over its bars in order, trade counts included: bars fold into days, days into the series."""
    level = F.transform("levels", lambda x: F.concat_ws("|", *[x[n].cast("string") for n in ("price_low", "buy_volume", "sell_volume", "buy_count", "sell_count")]))
    rows = bars.select(*keys, "time", digest([F.col("time"), F.col("trades_count"), F.array_join(level, ";")], "footprint").alias("d"))
    days = rows.groupBy(*keys, F.floor(F.col("time") / 86_400_000).alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", "d"))).alias("x"))
    days = days.select(*keys, "day", folded(F.transform("x", lambda y: y.d)).alias("d"))
    return days.groupBy(*keys).agg(folded(F.transform(F.array_sort(F.collect_list(F.struct("day", "d"))), lambda y: y.d)).alias("checksum"))
