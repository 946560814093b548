"""OHLCV bars from trades and from finer bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.hashing import DECIMAL, decimal_text, digest, folded
from candela.functions.timeframe import bucket, close_time, micros_to_ms, milliseconds


def bars_from_trades(trades: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",), order: str = "micros", anchor: str = "monday") -> DataFrame:
    """One bar per key and bucket; open and close go by ``order``, one long that is unique in a bucket."""
    return (
        trades.groupBy(*keys, bucket(F.col("time"), timeframe, anchor).alias("time"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum(F.col("quantity").cast(DECIMAL)).cast("double").alias("volume"),
            F.count(F.lit(1)).alias("trades_count"),
        )
        .withColumn("time_close", close_time(F.col("time"), timeframe))
    )


def _traded(function, value: str) -> Column:
    """By time, among the bars with volume; among all where none has any."""
    return F.coalesce(function(F.when(F.col("volume") > 0, F.col(value)), F.when(F.col("volume") > 0, F.col("time"))), function(F.col(value), F.col("time")))


def resample(bars: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",), anchor: str = "monday", start: int | None = None) -> DataFrame:
    """Coarser bars: open of the first and close of the last traded bar, extremes over all, exact volume, closed if all are.

    A bucket appears even if finer bars are missing in it; buckets that begin before ``start`` don't. A ``provider`` column
    must hold one value per bucket; a bucket with several raises MD_VALIDATION_ERROR.
    """
    at = bucket(F.col("time"), timeframe, anchor)
    source = bars if start is None else bars.where(F.col("time") >= start)
    out = {
        "open": _traded(F.min_by, "open"),
        "high": F.max("high"),
        "low": F.min("low"),
        "close": _traded(F.max_by, "close"),
        "volume": F.sum(F.col("volume").cast(DECIMAL)).cast("double"),
    }
    if "is_closed" in bars.columns:
        out["is_closed"] = F.bool_and("is_closed")
    if "provider" in bars.columns:
        clash = F.raise_error(F.lit("MD_VALIDATION_ERROR: several providers in a bucket")).cast("string")
        out["provider"] = F.when(F.min("provider").eqNullSafe(F.max("provider")), F.min("provider")).otherwise(clash)
    made = source.withColumn("__bucket", at).groupBy(*keys, "__bucket").agg(*[v.alias(k) for k, v in out.items()])
    made = made.withColumnRenamed("__bucket", "time")
    if start is not None:
        made = made.where(F.col("time") >= start)
    return made.withColumn("time_close", close_time(F.col("time"), timeframe) if anchor == "monday" else F.col("time") + milliseconds(timeframe) - 1)


def resample_exact(bars: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The exact texts of high (earliest of equal ones), low and summed volume per bucket, and a revision hash of its bars."""
    number = lambda name: F.col(name).cast(DECIMAL)
    row = digest([F.col(k) for k in ("time", "open_text", "high_text", "low_text", "close_text", "volume_text")], "bar")
    return (
        bars.groupBy(*keys, bucket(F.col("time"), timeframe).alias("bucket"))
        .agg(
            F.max_by("high_text", F.struct(number("high_text"), -F.col("time"))).alias("high_text"),
            F.min_by("low_text", F.struct(number("low_text"), "time")).alias("low_text"),
            F.sum(number("volume_text")).alias("volume_exact"),
            # A bucket holds as many bars as the timeframe has finer ones: a bounded list.
            folded(F.transform(F.array_sort(F.collect_list(F.struct("time", row.alias("d")))), lambda x: x.d)).alias("provider_revision"),
        )
        .withColumnRenamed("bucket", "time")
    )


def merge_same_open(rows: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",), ordinal: str = "ordinal") -> DataFrame:
    """Archive rows of the same (floored) open time as one bar: first open, last close by file order, extremes, summed volume.

    Exact texts, where the rows have them, go with the values that they stand for.
    """
    at = bucket(micros_to_ms(F.col("time")), timeframe)
    merged = {
        "open": F.min_by("open", ordinal), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", ordinal),
        "volume": F.sum(F.col("volume").cast(DECIMAL)).cast("double"),
    }
    if "open_text" in rows.columns:
        number = lambda name: F.col(name).try_cast(DECIMAL)
        merged |= {
            "open_text": F.min_by("open_text", ordinal), "high_text": F.max_by("high_text", F.struct(number("high_text"), -F.col(ordinal))),
            "low_text": F.min_by("low_text", F.struct(number("low_text"), ordinal)), "close_text": F.max_by("close_text", ordinal),
            # The text of a lone row is kept as it came.
            "volume_text": F.when(F.count(F.lit(1)) == 1, F.first("volume_text")).otherwise(decimal_text(F.sum(number("volume_text")))),
        }
    return rows.groupBy(*keys, at.alias("time")).agg(*[c.alias(n) for n, c in merged.items()])
