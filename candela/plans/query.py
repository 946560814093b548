"""Queries as values, compiled into predicates on stored columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.errors import InvalidBarQuery, InvalidInstrument
from candela.functions.timeframe import Timeframe, canonical, milliseconds


#: The kind of candles that are meant where none is named.
TRADE_KLINE = "trade_kline"


@dataclass(frozen=True)
class Instrument:
    exchange: str
    market: str
    symbol: str

    def __post_init__(self) -> None:
        for name, value in (("exchange", self.exchange.strip().lower()), ("market", self.market.strip().lower()), ("symbol", self.symbol.strip().upper())):
            if not value:
                raise InvalidInstrument(f"empty {name}")
            object.__setattr__(self, name, value)

    def serialize(self) -> str:
        return f"{self.exchange}/{self.market}/{self.symbol}"

    @classmethod
    def parse(cls, text: str) -> Instrument:
        parts = text.split("/")
        if len(parts) != 3:
            raise InvalidInstrument(text)
        return cls(*parts)


@dataclass(frozen=True)
class BarQuery:
    """Bars of one series in ``[start_ms, end_ms)``."""

    instrument: Instrument
    timeframe: Timeframe
    start_ms: int
    end_ms: int
    source_kind: str = TRADE_KLINE

    def __post_init__(self) -> None:
        if self.start_ms >= self.end_ms:
            raise InvalidBarQuery("start must be before end")

    def predicate(self) -> Column:
        """Literals on the stored columns, so that partitions are pruned and row groups skipped."""
        i = self.instrument
        same = (F.col("exchange") == i.exchange) & (F.col("market") == i.market) & (F.col("symbol") == i.symbol)
        return same & (F.col("timeframe") == self.timeframe.canonical) & (F.col("time") >= self.start_ms) & (F.col("time") < self.end_ms)


#: Policies of a footprint query on slots without a bar: those by which it fails, and all.
FAILS = ("fail", "strict")
POLICIES = (*FAILS, "allow", "allow_with_metadata")


@dataclass(frozen=True)
class FootprintQuery:
    """Footprint bars of ``[start_ms, end_ms)``, in buckets of a price, or of a number of ticks (one, unless given)."""

    instrument: Instrument
    timeframe: Timeframe
    start_ms: int
    end_ms: int
    price_bucket: float | None = None
    tick_size: float | None = None
    ticks_per_row: int | None = None
    gap_policy: str = field(default="allow")

    def __post_init__(self) -> None:
        if self.start_ms >= self.end_ms or self.timeframe.duration_ms is None:
            raise InvalidBarQuery("a footprint needs a range and a timeframe of fixed length")
        if self.gap_policy not in POLICIES:
            raise InvalidBarQuery(f"no gap policy {self.gap_policy}")
        if not self.bucket_size > 0:
            raise InvalidBarQuery("a footprint needs a positive price bucket, or tick size and ticks per row")

    @property
    def bucket_size(self) -> float:
        return self.price_bucket if self.price_bucket is not None else (self.tick_size or 0) * (1 if self.ticks_per_row is None else self.ticks_per_row)


def in_range(rows: DataFrame, start_ms: int, end_ms: int, *, stored: str | None = None) -> DataFrame:
    """Rows of ``[start_ms, end_ms)`` by ``time``, or by a stored timestamp column that ``time`` was derived from.

    Bounds on a derived column don't reach the scan; bounds on the stored one do.
    """
    if stored is None:
        return rows.where((F.col("time") >= start_ms) & (F.col("time") < end_ms))
    kind = rows.schema[stored].dataType.simpleString()
    bound = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
    return rows.where((F.col(stored) >= bound(start_ms)) & (F.col(stored) < bound(end_ms)))


def can_derive(base: str, wanted: str) -> bool:
    """Whether whole base candles make up the wanted one."""
    if "1M" in (canonical(base), canonical(wanted)):
        return False
    a, b = milliseconds(base), milliseconds(wanted)
    return a <= b and b % a == 0
