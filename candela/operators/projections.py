"""Bars told in other layouts: contract bars, canonical rows with exact texts, and back; guards on whose bars they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.hashing import decimal_text, digest
from candela.functions.identity import instrument_id, parsed_instrument
from candela.functions.timeframe import canonical_column, close_time_column
from candela.operators.coverage import coverage_report
from candela.plans.query import TRADE_KLINE, BarQuery

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")


def _stop(code: str, message: str | Column, kind: str = "string") -> Column:
    text = F.lit(f"{code}: {message}") if isinstance(message, str) else F.concat(F.lit(f"{code}: "), message)
    return F.raise_error(text).cast(kind)


def contract_bars(bars: DataFrame) -> DataFrame:
    """``instrument_id, timeframe``, times, values and ``closed``: a missing close time is computed, a bar that doesn't say is closed."""
    closed = F.coalesce("is_closed", F.lit(True)) if "is_closed" in bars.columns else F.lit(True)
    until = close_time_column(F.col("time"), F.col("timeframe"))
    return bars.select(
        instrument_id(F.col("exchange"), F.col("market"), F.col("symbol")).alias("instrument_id"), "timeframe", "time",
        (F.coalesce("time_close", until) if "time_close" in bars.columns else until).alias("time_close"), *VALUES, closed.alias("closed"),
    )


def market_bars(contract: DataFrame) -> DataFrame:
    """Contract bars as bars to store: a missing volume is 0, and the provider's revision is a hash of what the contract says."""
    volume = F.coalesce("volume", F.lit(0.0))
    said = [F.col(c) for c in ("instrument_id", "timeframe", "time", "time_close", *PRICES)] + [volume, F.col("closed")]
    name = parsed_instrument(F.col("instrument_id"))
    return contract.select(
        "time", *PRICES, volume.alias("volume"), "time_close", *[name.getField(k).alias(k) for k in ("exchange", "market", "symbol")], "timeframe", F.lit("api").alias("source_transport"),
        F.lit(TRADE_KLINE).alias("source_kind"), F.col("closed").alias("is_closed"), name.getField("exchange").alias("provider"), digest(said, "contract-bar").alias("provider_revision"),
    )


def canonical_rows(bars: DataFrame, *, provider: str | None = None) -> DataFrame:
    """Stored bars as rows that revisions are hashed from: exact decimals in plain notation, finality, provider and revision.

    A bar without finality stops the job with ``MD_MISSING_FINALITY``; one without close time, provider, provider's revision or
    an exact text of each value with ``MD_VALIDATION_ERROR``. ``provider`` stands in where a bar names none; a bar
    without a revision is the original.
    """
    has = lambda name: F.nullif(F.col(name), F.lit("")) if name in bars.columns else F.lit(None).cast("string")
    needed = lambda value, what: F.coalesce(value, _stop("MD_VALIDATION_ERROR", f"a bar has no {what}"))
    closed = F.col("is_closed") if "is_closed" in bars.columns else F.lit(None).cast("boolean")
    until = F.col("time_close") if "time_close" in bars.columns else F.lit(None).cast("long")
    series = instrument_id(F.col("exchange"), F.col("market"), F.col("symbol"))
    return bars.select(
        F.concat_ws("/", series, "timeframe").alias("series"), series.alias("instrument_id"), "timeframe", "time",
        F.coalesce(until, _stop("MD_VALIDATION_ERROR", "a bar has no close time", "long")).alias("time_close"),
        *[needed(decimal_text(needed(has(f"{n}_text"), f"exact text of its {n}")), f"decimal for its {n}").alias(n) for n in VALUES],
        F.when(closed.isNull(), _stop("MD_MISSING_FINALITY", "a bar doesn't say whether it is closed")).when(closed, "FINAL").otherwise("OPEN").alias("finality"),
        F.coalesce(has("revision_state"), F.lit("ORIGINAL")).alias("revision_state"), (F.coalesce("revision", F.lit(0)) if "revision" in bars.columns else F.lit(0)).cast("long").alias("revision"),
        needed(F.coalesce(has("provider"), F.lit(provider)), "provider").alias("provider"), needed(has("provider_revision"), "provider's revision").alias("provider_revision"),
    )


def from_canonical(rows: DataFrame) -> DataFrame:
    """Canonical rows as bars again, with their values as numbers and as texts."""
    name = parsed_instrument(F.col("instrument_id"))
    return rows.select(
        "time", "time_close", *[F.col(n).cast("double").alias(n) for n in VALUES], *[name.getField(k).alias(k) for k in ("exchange", "market", "symbol")], "timeframe",
        F.lit("canonical").alias("source_transport"), (F.col("finality") == "FINAL").alias("is_closed"), "provider", "provider_revision", "revision_state", "revision",
        *[F.col(n).cast("string").alias(f"{n}_text") for n in VALUES],
    )


def strangers(bars: DataFrame, query: BarQuery) -> DataFrame:
    """Bars that aren't of the query's series, and in what they differ: ``exchange``, ``market``, ``symbol`` or ``timeframe``.
    Other spellings of one timeframe are the same."""
    i = query.instrument
    differs = lambda name, value, own: F.when(~F.coalesce(value == own, F.lit(False)), name)
    found = F.coalesce(
        differs("exchange", F.lower(F.trim("exchange")), i.exchange), differs("market", F.lower(F.trim("market")), i.market),
        differs("symbol", F.upper(F.trim("symbol")), i.symbol), differs("timeframe", canonical_column(F.col("timeframe")), query.timeframe.canonical),
    )
    return bars.withColumn("differs", found).where("differs IS NOT NULL")


def own_bars(bars: DataFrame, query: BarQuery) -> DataFrame:
    """``bars``, of which one that isn't of the query's series stops the job; checked where they are read, in no pass of its own."""
    i = query.instrument
    same = (F.lower(F.trim("exchange")) == i.exchange) & (F.lower(F.trim("market")) == i.market) & (F.upper(F.trim("symbol")) == i.symbol)
    same = same & (canonical_column(F.col("timeframe")) == query.timeframe.canonical)
    name = F.concat_ws("/", "exchange", "market", "symbol", "timeframe")
    torn = _stop("MD_VALIDATION_ERROR", F.concat(name, F.lit(f" isn't {i.serialize()}/{query.timeframe.canonical}")), "boolean")
    return bars.where(F.when(F.coalesce(same, F.lit(False)), True).otherwise(torn))


def series(bars: DataFrame, query: BarQuery) -> tuple[DataFrame, DataFrame]:
    """Contract bars of a query, and the report of how they cover its range."""
    made = contract_bars(own_bars(bars, query))
    asked = made.sparkSession.range(1).select(F.lit(query.instrument.serialize()).alias("instrument_id"), F.lit(query.start_ms).alias("start"), F.lit(query.end_ms).alias("end"))
    return made, coverage_report(made, asked, query.timeframe.canonical, keys=("instrument_id",))
