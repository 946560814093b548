"""Violations as rows, and guards that stop a job on the first one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.errors import ValidationError
from candela.functions.hashing import DECIMAL
from candela.operators.ordered import with_previous


def finality(time_close: Column, server_time_ms: int | Column) -> Column:
    """A candle is final once the server's time reaches its close."""
    now = F.lit(server_time_ms) if isinstance(server_time_ms, int) else server_time_ms
    return F.when(now >= time_close, "FINAL").otherwise("OPEN")


def exclude_open(bars: DataFrame, server_time_ms: int | None) -> DataFrame:
    """Bars that have closed; a bar without a close time stops the job."""
    if server_time_ms is None:
        raise ValidationError("the server's time is needed to leave out open candles")
    stop = F.raise_error(F.lit("MD_MISSING_FINALITY: a bar has no close time")).cast("boolean")
    return bars.where(F.when(F.col("time_close").isNull(), stop).otherwise(F.col("time_close") <= server_time_ms))


def bar_violations(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), strict_close: bool = False) -> DataFrame:
    """A row per bar and broken rule: duplicate, high, low, close_time, volume, missing."""
    rows = with_previous(bars, keys, "time", {"__before": F.col("time")}, tie=("open", "high", "low", "close"))
    late = F.col("time_close") <= F.col("time") if strict_close else F.col("time_close") < F.col("time")
    prices = ("open", "high", "low", "close")
    rules = {
        "duplicate": F.col("__before") == F.col("time"),
        "high": F.col("high") < F.greatest("open", "close"),
        "low": F.col("low") > F.least("open", "close"),
        "close_time": late,
        "volume": F.col("volume") < 0,
        "missing": F.greatest(*[F.col(p).isNull().cast("int") for p in prices]) == 1,
    }
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.select(*keys, "time", F.explode(F.array_compact(broken)).alias("rule"))


def text_violations(bars: DataFrame) -> DataFrame:
    """Bars whose exact decimal texts are no decimals or no candle."""
    names = ("open_text", "high_text", "low_text", "close_text", "volume_text")
    o, h, low, c, v = (F.col(x).try_cast(DECIMAL) for x in names)
    good = (low <= o) & (low <= c) & (o <= h) & (c <= h) & (v >= 0)  # null if any is no decimal
    return bars.where(~F.coalesce(good, F.lit(False)))


def field_violations(bars: DataFrame) -> DataFrame:
    """Rows whose canonical fields are incoherent, with an MD code: missing identity, finality, revision or lineage."""
    empty = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    original = F.col("revision_state") == "ORIGINAL"
    code = (
        F.when(empty("exchange") | empty("market") | empty("symbol") | empty("timeframe") | empty("provider"), "MD_VALIDATION_ERROR")
        .when(F.col("is_closed").isNull(), "MD_MISSING_FINALITY")
        .when(~F.coalesce(F.col("revision_state").isin("ORIGINAL", "CORRECTED", "REVOKED"), F.lit(False)), "MD_VALIDATION_ERROR")
        .when(~F.coalesce(F.when(original, F.col("revision") == 0).otherwise(F.col("revision") >= 1), F.lit(False)), "MD_VALIDATION_ERROR")
        .when(F.least(*[F.coalesce(c, F.lit(0)) for c in ("trades_count", "downloaded_at")]) < 0, "MD_VALIDATION_ERROR")
    )
    return bars.withColumn("code", code).where("code IS NOT NULL")


def guard(rows: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``rows`` if there is no violation, else an error; the one action is a look for a first violation."""
    found = violations.limit(1).collect()
    if found:
        raise ValidationError(f"{message}: {found[0].asDict()}")
    return rows


def one_series(bars: DataFrame, keys: Sequence[str] = ("exchange", "market", "symbol", "timeframe", "source_kind")) -> DataFrame:
    """Whether a batch may be written at once: all closed, one series."""
    return bars.agg((F.coalesce(F.bool_and("is_closed"), F.lit(True)) & (F.count_distinct(F.struct(*keys)) <= 1)).alias("eligible"))
