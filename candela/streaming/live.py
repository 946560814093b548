"""Live candles as keyed state, and a sink that writes what has closed into a store exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candela.functions.timeframe import close_time_column
from candela.plans.query import TRADE_KLINE
from candela.schemas import struct
from candela.store import BarStore
from candela.streaming.klines import CANDLE

VALUES = ("open", "high", "low", "close", "volume")
#: What becomes of an update.
OUTCOME = struct(
    "exchange string, market string, symbol string, timeframe string, open_time long, event_time long, is_closed boolean, backfilled boolean,"
    " open double, high double, low double, close double, volume double, outcome string"
)
_STATE = "event_time long, is_closed boolean, open double, high double, low double, close double, volume double"
OUTCOMES = ("upserted", "committed", "duplicate", "conflict", "late_open_ignored")


class LiveCandle(StatefulProcessor):
    """State of one candle: its last values, open or closed.

    Open updates replace the state, unless a later one is there already; the first close commits; the same close again is a
    duplicate, another one a conflict, and an open update after the close is late. A candle's state goes once the watermark
    is ``keep_ms`` past its last event: then no update of it can come that isn't dropped as late.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.candle = handle.getValueState("candle", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["seq", "event_time", "is_closed"], kind="stable").reset_index(drop=True)
        state = self.candle.get() if self.candle.exists() else None
        before = state
        values = list(zip(events["event_time"].tolist(), events["is_closed"].tolist(), *[events[v].tolist() for v in VALUES], strict=True))
        outcomes = []
        for row in values:
            if not row[1]:
                late = state is not None and state[1]
                outcomes.append("late_open_ignored" if late else "upserted")
                if not late and (state is None or row[0] >= state[0]):
                    state = row
            elif state is None or not state[1]:
                outcomes.append("committed")
                state = row
            else:
                outcomes.append("duplicate" if tuple(state[2:]) == tuple(row[2:]) else "conflict")
        if state is not before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.candle.update(tuple(state))
            self.handle.registerTimer(state[0] + self.keep_ms)
        named = {n: [v] * len(events) for n, v in zip(CANDLE, key, strict=True)}
        yield pd.DataFrame({**named, **{n: events[n] for n in ("event_time", "is_closed", "backfilled", *VALUES)}, "outcome": outcomes})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.candle.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_candles(updates: DataFrame, *, delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """The outcome and values of each update of a stream; needs the RocksDB state store.

    Updates of a candle in one micro-batch are taken by ``seq`` (0 where they have none), then by time and openness. Events more
    than ``delay`` behind the latest are dropped. ``backfilled`` rows take part as the others do.
    """
    more = {"seq": F.lit(0).cast("long"), "backfilled": F.lit(False)}
    placed = updates.withColumns({n: c for n, c in more.items() if n not in updates.columns})
    placed = placed.withColumn("at", F.timestamp_millis("event_time")).withWatermark("at", delay)
    kept = placed.select(*CANDLE, "at", "event_time", "seq", "is_closed", "backfilled", *[F.col(v).cast("double") for v in VALUES])
    return kept.groupBy(*CANDLE).transformWithStateInPandas(LiveCandle(keep_ms), OUTCOME, "Append", "EventTime")


def updates_with_backfill(updates: DataFrame, backfill: DataFrame) -> DataFrame:
    """Updates of a stream with a second stream of closed candles that were fetched after a break: by arrival, in one state.

    A candle that the stream missed is committed by its backfill; one that it has is a duplicate, whichever comes first.
    """
    rest = [c for c in updates.columns if c != "backfilled"]
    closed = backfill.where("is_closed").withColumn("backfilled", F.lit(True))
    return updates.select(*rest).withColumn("backfilled", F.lit(False)).unionByName(closed.select(*rest, "backfilled"))


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The candles that the stream's state holds, as of its last batch, read from the checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "candle").load(checkpoint)
    return rows.select(*[F.col(f"key.{n}").alias(n) for n in CANDLE], "value.*")


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open candles: those whose last update is no close."""
    return state_of(spark, checkpoint).where("NOT is_closed").drop("is_closed")


@dataclass
class StoreSink:
    """Writes each micro-batch's committed candles into a store, once.

    The commit carries the stream's name and the batch's number. A batch that comes again after a crash either finds its
    number there and is passed over, or finds no marker, and is written anew over what was left. Conflicting candles
    are appended to ``conflicts`` below the store, by batch, so that they too are there once.
    """

    store: BarStore
    name: str
    counts: dict[str, int] = field(default_factory=dict)
    on_commit: Callable[[int, dict[str, int]], None] | None = None

    def __call__(self, outcomes: DataFrame, batch: int) -> None:
        known = self.store.token(self.name) if self.store.versions() else None
        if known is not None and batch <= known:
            return
        outcomes = outcomes.persist()
        try:
            for r in outcomes.groupBy("outcome").count().collect():
                self.counts[r["outcome"]] = self.counts.get(r["outcome"], 0) + r["count"]
            bars = outcomes.where("outcome = 'committed'").select(
                *CANDLE[:-1], F.lit(TRADE_KLINE).alias("source_kind"), F.col("open_time").alias("time"), *VALUES, close_time_column(F.col("open_time"), F.col("timeframe")).alias("time_close"), F.lit(True).alias("is_closed"),
            )
            clashing = outcomes.where("outcome = 'conflict'").withColumn("batch", F.lit(batch).cast("long"))
            if not clashing.isEmpty():
                clashing.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.store.path}/conflicts")
            written = {"new": 0, "duplicate": 0} if bars.isEmpty() else self.store.write_closed(bars, token=(self.name, batch))
            if self.on_commit:
                self.on_commit(batch, written)
        finally:
            outcomes.unpersist()

    def conflicts(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.path}/conflicts")


def into_store(updates: DataFrame, sink: StoreSink, checkpoint: str, *, delay: str = "1 hour", keep_ms: int = 3_600_000) -> None:
    """Run a stream of updates over what its source holds now, into the sink's store. The checkpoint lets it go on later."""
    spark = updates.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        outcomes = live_candles(updates, delay=delay, keep_ms=keep_ms)
        outcomes.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
