"""Keyed merges and comparisons of bar sets: precedence, audit, repair, bulk write, gap fill, intrabar lookup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.hashing import digest
from candela.functions.timeframe import milliseconds
from candela.schemas import CANDLE

OHLCV = ("open", "high", "low", "close", "volume")


def candle_fields(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """The fields of a candle's identity that both tables have: transport, download time and provenance aren't among them."""
    return [f for f in CANDLE if f in left.columns and f in right.columns and f not in keys]


def candle_identity(columns: Sequence[str]) -> Column:
    """One digest of a candle's identity, of the fields in ``columns``."""
    return digest([F.col(f) for f in CANDLE if f in columns], "candle")


def _beside(source: DataFrame, store: DataFrame, keys: Sequence[str], fields: Sequence[str] | None, how: str, row: Sequence[str] = ()) -> DataFrame:
    """Both tables by key: ``a`` and ``b`` are the candles of source and store, null where there is none."""
    fields = candle_fields(source, store, keys) if fields is None else fields
    a = source.select(*keys, F.struct(*fields).alias("a"), *([F.struct(*row).alias("row")] if row else []))
    return a.join(store.select(*keys, F.struct(*fields).alias("b")), list(keys), how)


def keep_last(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Per key the row with the greatest ``seq``: an aggregate that combines before it shuffles, not a window."""
    return _keep(rows, keys, F.max_by, seq)


def keep_first(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return _keep(rows, keys, F.min_by, seq)


def _keep(rows: DataFrame, keys: Sequence[str], pick, seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(pick(F.struct(*rest), seq).alias("__row"))
    return kept.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest]).select(*rows.columns)


def prefer_later(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources in which a later one wins each key (archive, then REST; stored, then derived)."""
    ranked = [s.withColumn("__rank", F.lit(k).cast("long")) for k, s in enumerate(sources)]
    return keep_last(reduce(DataFrame.unionByName, ranked), keys, "__rank").drop("__rank")


def audit(source: DataFrame, store: DataFrame, *, keys: Sequence[str] = ("symbol", "time"), fields: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Source bars that the store lacks (missing) or holds otherwise (mismatch); if strict, store bars the source lacks (extra).

    Bars are compared by the fields of a candle's identity that both tables have, or by ``fields``.
    """
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "mismatch")
    kind = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b")), None).otherwise(F.coalesce(kind, F.lit("mismatch")))
    return _beside(source, store, keys, fields, "full" if strict else "left").select(*keys, kind.alias("kind")).where("kind IS NOT NULL")


def audit_counts(source: DataFrame, store: DataFrame, *, keys: Sequence[str] = ("symbol", "time"), fields: Sequence[str] | None = None, strict: bool = False, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """A row per series: bars ``checked``, and how many are ``missing``, differ (``mismatch``), are ``extra``, and would be ``changed`` by a repair."""
    found = _beside(source, store, keys, fields, "full" if strict else "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = {"checked": a, "missing": a & ~b, "mismatch": a & b & ~F.col("a").eqNullSafe(F.col("b")), "extra": ~a & b}
    return found.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("changed", F.col("missing") + F.col("mismatch") + F.col("extra"))


def repaired(source: DataFrame, store: DataFrame, *, keys: Sequence[str] = ("symbol", "time"), strict: bool = False) -> DataFrame:
    """The store with the source's bars taking precedence; if strict, without bars that the source lacks."""
    if strict:
        store = store.join(source.select(*keys), list(keys), "left_semi")
    return prefer_later([store.select(*source.columns), source], keys)


def classify_bulk(batch: DataFrame, store: DataFrame, *, keys: Sequence[str] = ("symbol", "time"), fields: Sequence[str] | None = None) -> DataFrame:
    """Each bar of a closed batch as ``new``, ``duplicate`` (same candle, in all fields of its identity) or ``conflict``."""
    outcome = F.when(F.col("b").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "duplicate").otherwise("conflict")
    return _beside(batch, store, keys, fields, "left", batch.columns).select("row.*", outcome.alias("outcome"))


def batch_conflicts(batch: DataFrame, *, keys: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Keys that a batch gives with different candles, and with how many."""
    own = batch.select(*keys, candle_identity([c for c in batch.columns if c not in keys]).alias("candle"))
    return own.groupBy(*keys).agg(F.count_distinct("candle").alias("candles")).where("candles > 1")


def fill_gaps(store: DataFrame, archive: DataFrame, missing: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The store and those archive bars that stand in its missing slots (``start``)."""
    holes = missing.select(*keys, F.col("start").alias("time"))
    return store.unionByName(archive.join(holes, [*keys, "time"], "left_semi").select(*store.columns))


def intrabar(chart: DataFrame, lower: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each chart bar with the finer bars inside ``[time, time_close]``: an equi-join on the chart's grid, then the exact bounds.

    A chart bar may open off the grid or be longer than one slot; it is looked up in every slot that it touches.
    """
    step = milliseconds(timeframe)
    slot = lambda t: F.floor(t / step)
    left = chart.select(*keys, F.col("time").alias("chart_time"), F.col("time_close").alias("chart_close"))
    left = left.withColumn("__slot", F.explode(F.sequence(slot(F.col("chart_time")), slot(F.col("chart_close")))))
    right = lower.withColumn("__slot", slot(F.col("time")))
    return left.join(right, [*keys, "__slot"]).where("time BETWEEN chart_time AND chart_close").drop("__slot")


def overlay_current(bars: DataFrame, current: DataFrame, *, keys: Sequence[str] = ("symbol",), start: int, end: int) -> DataFrame:
    """Closed bars and the open candles inside the range, where no closed bar of that time is."""
    inside = current.where((F.col("time") >= start) & (F.col("time") < end)).join(bars.select(*keys, "time"), [*keys, "time"], "left_anti")
    return bars.unionByName(inside.select(*bars.columns))


def manifest(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """A row per series: bars, first and last time, close of the last bar; with ``downloaded_at``, the last download, 0 if unknown."""
    more = [F.coalesce(F.max("downloaded_at"), F.lit(0).cast("long")).alias("downloaded_at")] if "downloaded_at" in bars.columns else []
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_count"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.max_by("close", "time").alias("last_close"), *more,
    )
