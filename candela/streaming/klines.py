"""Live candles: a commit state machine per candle, coalescing, streaming bars and checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candela.functions.hashing import digest
from candela.functions.timeframe import milliseconds
from candela.schemas import CANDLE as IDENTITY
from candela.schemas import struct

CANDLE = ("exchange", "market", "symbol", "timeframe", "open_time")
#: What two closes of a candle are compared by: the fields of its identity, as far as updates have them.
FIELDS = tuple(f for f in IDENTITY if f not in CANDLE and f != "time")
OUTCOME = struct("exchange string, market string, symbol string, timeframe string, open_time long, event_time long, outcome string")


def _arrived(updates: DataFrame) -> DataFrame:
    """Updates with the digest of their whole candle and their order: ``seq`` if they have one, else time of the event and openness."""
    order = F.struct("seq") if "seq" in updates.columns else F.struct("event_time", "is_closed")
    names = [c for c in updates.columns if c not in ("event_time", "seq", "is_closed", *CANDLE)]
    fields = [F.col(c) for c in sorted(names) if c in FIELDS]
    return updates.select(*CANDLE, "event_time", "is_closed", order.alias("place"), digest(fields, "live-candle").alias("candle"))


class CommitCandles(StatefulProcessor):
    """State of one candle: open updates are upserted; the first close commits; the same close again is a duplicate, another one
    a conflict; an open update after the close is late and ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "candle string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("place", kind="stable")
        state = self.closed.get()[0] if self.closed.exists() else None
        outcomes = []
        for event in events.itertuples(index=False):
            if not event.is_closed:
                outcomes.append("upserted" if state is None else "late_open_ignored")
            elif state is None:
                state = event.candle
                self.closed.update((state,))
                outcomes.append("committed")
            else:
                outcomes.append("duplicate" if state == event.candle else "conflict")
        yield pd.DataFrame({**{n: [v] * len(outcomes) for n, v in zip(CANDLE, key, strict=True)}, "event_time": events["event_time"].tolist(), "outcome": outcomes})

    def close(self) -> None:
        pass


def commit_stream(updates: DataFrame) -> DataFrame:
    """Outcome of each update of a stream; needs the RocksDB state store."""
    placed = _arrived(updates)
    text = F.col("place.seq") * 2 if "seq" in updates.columns else F.col("place.event_time") * 2 + F.col("place.is_closed").cast("long")
    return placed.withColumn("place", text).groupBy(*CANDLE).transformWithStateInPandas(CommitCandles(), OUTCOME, "Append", "None")


def commit_batch(updates: DataFrame) -> DataFrame:
    """The same outcomes for a finite set of updates, by windows over each candle."""
    order = Window.partitionBy(*CANDLE).orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(F.col("is_closed"), F.col("candle")), ignorenulls=True)
    before = F.coalesce(F.max("is_closed").over(so_far), F.lit(False))
    outcome = (
        F.when(~F.col("is_closed"), F.when(before, "late_open_ignored").otherwise("upserted"))
        .when(~before, "committed").when(first.over(so_far) == F.col("candle"), "duplicate").otherwise("conflict")
    )
    return _arrived(updates).select(*CANDLE, "event_time", outcome.alias("outcome"))


def commit_counts(outcomes: DataFrame, keys: Sequence[str] = ("exchange", "market", "symbol", "timeframe")) -> DataFrame:
    """Per series how many updates were processed, and how many came to each outcome."""
    names = ("upserted", "committed", "duplicate", "conflict", "late_open_ignored")
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def with_backfill(updates: DataFrame, backfill: DataFrame, after: int) -> DataFrame:
    """Updates by ``seq`` with the closed candles of a backfill placed behind the first ``after`` of them, as after a reconnect.

    Sequence numbers are doubled to make room; updates that come again later are duplicates of the backfilled ones.
    """
    closed = backfill.where("is_closed")
    placed = closed.select(*[c for c in updates.columns if c != "seq"], F.lit(2 * after + 1).cast("long").alias("seq"))
    return updates.withColumn("seq", F.col("seq") * 2 + F.when(F.col("seq") > after, 2).otherwise(0)).unionByName(placed)


def event_revision(updates: DataFrame, *, event_id: str = "raw_event_id") -> Column:
    """The revision that a live event stands for: its own id, else a hash of its candle."""
    fields = [F.col(c) for c in sorted(updates.columns) if c in FIELDS or c in CANDLE]
    own = F.col(event_id) if event_id in updates.columns else F.lit(None).cast("string")
    return F.coalesce(F.when(F.trim(own) != "", own), digest([*fields, F.col("event_time"), F.col("is_closed")], "live-event"))


def coalesce_updates(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Of the updates of each candle the last one, with the place of the first: what a queue that replaces in place holds."""
    rest = [c for c in updates.columns if c not in CANDLE]
    last = updates.groupBy(*CANDLE).agg(F.max_by(F.struct(*rest), seq).alias("r"), F.min(seq).alias("place"), (F.count(F.lit(1)) - 1).alias("coalesced"))
    return last.select(*CANDLE, "r.*", "place", "coalesced")


def bounded(queue: DataFrame, size: int) -> DataFrame:
    """A queue of at most ``size`` candles: the latest placed ones stay."""
    return queue.orderBy(F.desc("place"), *CANDLE).limit(size)


def dropped(queue: DataFrame, size: int) -> DataFrame:
    """The candles that a queue of ``size`` loses, oldest placed first."""
    return queue.join(bounded(queue, size).select(*CANDLE), list(CANDLE), "left_anti").orderBy("place", *CANDLE)


def current_candles(updates: DataFrame) -> DataFrame:
    """The last open update of each candle that has no closed one."""
    rest = [c for c in updates.columns if c not in CANDLE]
    grouped = updates.groupBy(*CANDLE).agg(F.max_by(F.struct(*rest), "event_time").alias("r"), F.max("is_closed").alias("done"))
    return grouped.where("NOT done").select(*CANDLE, "r.*")


def checkpoints(updates: DataFrame) -> DataFrame:
    """Per series the last closed candle, the last event and their number; with ``received_at`` and ``reconnect`` the last receipt
    and the number of reconnects; a batch or a stream. A series without a closed candle is still ``starting``."""
    closed = F.max(F.when(F.col("is_closed"), F.col("open_time")))
    more = [F.max("received_at").alias("last_received")] if "received_at" in updates.columns else []
    more += [F.count_if("reconnect").alias("reconnects")] if "reconnect" in updates.columns else []
    return updates.groupBy(*CANDLE[:-1]).agg(
        closed.alias("last_closed"), F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("events"), *more, F.when(closed.isNull(), "starting").otherwise("live").alias("status"),
    )


def drained(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, into Parquet below ``root``; mode ``complete`` leaves the last state.

    The checkpoint below ``root`` lets a stopped stream go on where it was.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        if mode == "append":
            writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        else:
            writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{root}/out")).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_bars(trades: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",), at: str = "at", delay: str = "2 days", order: str = "micros") -> DataFrame:
    """Bars of a trade stream by event time. A bar is emitted once the watermark passes its end; later trades are dropped."""
    seconds = milliseconds(timeframe) // 1000
    window = F.window(at, f"{seconds} seconds")
    return trades.withWatermark(at, delay).groupBy(*keys, window.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").cast("double").alias("volume"),
    ).select(*keys, F.unix_millis("w.start").alias("time"), "open", "high", "low", "close", "volume")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, timeout: int | None = None) -> None:
    """Consume what a stream holds now; ``apply`` gets each micro-batch and its id, by which it can skip one it has seen."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
