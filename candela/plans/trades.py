"""Raw trades of an instrument, cached by day, and footprints made from them: only what isn't there yet is fetched."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.errors import CoverageError
from candela.functions.timeframe import DAY
from candela.operators.coverage import missing_slots
from candela.operators.footprint import footprint_levels
from candela.plans.query import FAILS, FootprintQuery, Instrument
from candela.schemas import TRADES
from candela.sources.decode import unique_trades

KEYS = ("exchange", "market", "symbol")
#: A source of trades gives those of ``[start, end)``.
Trades = Callable[[int, int], DataFrame]


def subtracted(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of ``[start, end)`` no interval covers, in order; intervals may overlap and touch."""
    out, at = [], start
    for a, b in sorted(known):
        if a > at:
            out.append((at, min(a, end)))
        at = max(at, b)
        if at >= end:
            break
    return [(a, b) for a, b in [*out, (at, end)] if a < b]


@dataclass
class TradeCache:
    """Trades below ``path``, a folder per instrument, day and fetch, and the intervals of time that fetches covered.

    A fetch writes its trades first and its interval last. Reads go to those fetches alone whose interval stands there, so a
    fetch that died before its end is unseen and made again; nothing is overwritten. A day without any trade is covered too.
    """

    spark: SparkSession
    path: str

    def _exists(self, part: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _of(self, rows: DataFrame, instrument: Instrument, start: int, end: int) -> DataFrame:
        same = (F.col("exchange") == instrument.exchange) & (F.col("market") == instrument.market) & (F.col("symbol") == instrument.symbol)
        return rows.where(same & F.col("day").between(start // DAY, (end - 1) // DAY))

    def covered(self, instrument: Instrument, start: int, end: int) -> DataFrame:
        """Intervals of the days of a range, as ``day, start, end, fetch``."""
        kind = "start long, end long, fetch string, exchange string, market string, symbol string, day long"
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/covered") if self._exists("covered") else self.spark.createDataFrame([], kind)
        return self._of(rows, instrument, start, end)

    def missing(self, instrument: Instrument, start: int, end: int) -> list[tuple[int, int]]:
        """What of the range was never fetched. A day has as many intervals as fetches, so the driver sees days times fetches."""
        return subtracted(start, end, [(r["start"], r["end"]) for r in self.covered(instrument, start, end).collect()])

    def add(self, instrument: Instrument, start: int, end: int, trades: DataFrame) -> None:
        """Keep the trades of an interval; others that the source gave are dropped."""
        fetch = uuid.uuid4().hex
        names = {k: F.lit(getattr(instrument, k)) for k in KEYS} | {"day": F.floor(F.col("time") / DAY), "fetch": F.lit(fetch)}
        rows = trades.where((F.col("time") >= start) & (F.col("time") < end)).select(*[F.col(f.name).cast(f.dataType) for f in TRADES]).withColumns(names)
        rows.repartition("day").sortWithinPartitions("day", "time", "trade_id").write.mode("append").partitionBy(*KEYS, "day", "fetch").parquet(f"{self.path}/trades")
        days = self.spark.range(start // DAY, (end - 1) // DAY + 1).select(
            F.greatest(F.col("id") * DAY, F.lit(start)).alias("start"), F.least((F.col("id") + 1) * DAY, F.lit(end)).alias("end"), F.lit(fetch).alias("fetch"),
            *[names[k].alias(k) for k in KEYS], F.col("id").alias("day"),
        )
        days.coalesce(1).write.mode("append").partitionBy(*KEYS, "day").parquet(f"{self.path}/covered")

    def read(self, instrument: Instrument, start: int, end: int) -> DataFrame:
        """The trades of a range, each once, from the folders of its days and of whole fetches."""
        kind = "trade_id long, time long, price double, quantity double, buyer_maker boolean, exchange string, market string, symbol string, day long, fetch string"
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/trades") if self._exists("trades") else self.spark.createDataFrame([], kind)
        whole = self.covered(instrument, start, end).select("day", "fetch").distinct()
        inside = self._of(rows, instrument, start, end).where((F.col("time") >= start) & (F.col("time") < end))
        return unique_trades(inside.join(whole, ["day", "fetch"], "left_semi").drop("day", "fetch"), KEYS)

    def get(self, instrument: Instrument, start: int, end: int, source: Trades, *, until: int | None = None) -> DataFrame:
        """The trades of a range: the source is asked for what is missing, and what it gives is kept.

        ``until`` is the server's time: what lies beyond it hasn't happened yet and stays missing.
        """
        for a, b in self.missing(instrument, start, end if until is None else min(end, until)):
            self.add(instrument, a, b, source(a, b))
        return self.read(instrument, start, end)


@dataclass(frozen=True)
class Footprint:
    """Levels of a query's bars, the slots that have none, and the end of what the trades reach."""

    levels: DataFrame
    missing: DataFrame
    delivered_end: int | None


def cached_footprint(query: FootprintQuery, cache: TradeCache, source: Trades, *, until: int | None = None) -> Footprint:
    """Footprint bars from cached trades; by the policy that fails, a slot without a bar is an error.

    ``delivered_end`` is the end of the last bar that has trades.
    """
    i, name = query.instrument, query.timeframe.canonical
    trades = cache.get(i, query.start_ms, query.end_ms, source, until=until)
    levels = footprint_levels(trades, name, query.bucket_size, keys=KEYS, start=query.start_ms)
    bars = levels.select(*KEYS, "time", "time_close").distinct()
    asked = cache.spark.range(1).select(*[F.lit(getattr(i, k)).alias(k) for k in KEYS], F.lit(query.start_ms).alias("start"), F.lit(query.end_ms).alias("end"))
    missing = missing_slots(bars, asked, name, keys=KEYS)
    if query.gap_policy in FAILS:
        first = missing.orderBy("start").limit(1).collect()
        if first:
            raise CoverageError(f"no footprint bar at {first[0]['start']}")
    return Footprint(levels, missing, bars.agg(F.max("time_close").alias("e")).first()["e"])
