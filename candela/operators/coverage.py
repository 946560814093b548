"""Gaps and coverage. The definitions differ on purpose: per missing slot, coalesced, exact sequence, subset, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.timeframe import canonical, milliseconds
from candela.operators.ordered import with_previous, with_running_max

#: Slots per generated block: the grid of a long range is made of many short sequences.
BLOCK = 10_000


def grid(ranges: DataFrame, timeframe: str, *, start: str = "start", end: str = "end") -> DataFrame:
    """A row ``time`` per slot of ``[start, end)`` from each row of ``ranges``."""
    step = milliseconds(timeframe)
    blocks = ranges.where(F.col(start) < F.col(end)).withColumn("__block", F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(step * BLOCK))))
    last = F.least(F.col("__block") + step * (BLOCK - 1), F.col(end) - 1)
    return blocks.withColumn("time", F.explode(F.sequence(F.col("__block"), last, F.lit(step)))).drop("__block")


def series_ranges(bars: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First open and exclusive end of each series: a row per series."""
    return bars.groupBy(*keys).agg(F.min("time").alias("start"), (F.max("time") + milliseconds(timeframe)).alias("end"))


def missing_slots(bars: DataFrame, ranges: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One interval per grid slot without a bar. Grids begin at the start asked for: unaligned starts miss everything."""
    if canonical(timeframe) == "1M":
        return ranges.limit(0).select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    slots = grid(ranges.select(*keys, "start", "end"), timeframe).select(*keys, "time")
    found = bars.select(*keys, "time")
    return slots.join(found, [*keys, "time"], "left_anti").select(*keys, F.col("time").alias("start"), (F.col("time") + milliseconds(timeframe)).alias("end"))


def coalesced_gaps(bars: DataFrame, ranges: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Maximal intervals of each range that no bar covers, the tail included; bars may overlap."""
    rows = bars.select(*keys, "time", (F.col("time_close") + 1).alias("until")).join(ranges.select(*keys, F.col("start").alias("__from"), F.col("end").alias("__to")), list(keys))
    rows = rows.where("time >= __from AND time < __to")
    walked = with_running_max(rows, keys, "time", "until", "cursor", tie=("until",))
    inner = walked.select(*keys, F.greatest("__from", F.coalesce("cursor", "__from")).alias("start"), F.col("time").alias("end")).where("start < end")
    reached = rows.groupBy(*keys).agg(F.max("until").alias("reached"))
    tail = ranges.join(reached, list(keys), "left").select(*keys, F.greatest("start", F.coalesce("reached", "start")).alias("start"), "end").where("start < end")
    return inner.unionByName(tail.select(*keys, "start", "end"))


def islands(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Covered ranges: bars that overlap or touch, merged."""
    rows = bars.select(*keys, F.col("time").alias("start"), (F.col("time_close") + 1).alias("end"))
    return coalesced_intervals(rows, keys=keys)


def coalesced_intervals(rows: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Intervals merged where one starts at or before the end reached so far.

    The starts of merged ranges are found with a chunked running maximum; each range's end is the greatest end reached
    before the next range starts. Only a row per merged range is ordered at last.
    """
    walked = with_running_max(rows.select(*keys, "start", "end"), keys, "start", "end", "reached", tie=("end",))
    heads = walked.where("reached IS NULL OR start > reached")
    following = with_previous(heads.withColumn("__back", -F.col("start")), keys, "__back", {"next_reached": F.col("reached")})
    most = rows.groupBy(*keys).agg(F.max("end").alias("most"))
    return following.join(most, list(keys)).select(*keys, "start", F.coalesce("next_reached", "most").alias("end"))


def coverage_report(bars: DataFrame, ranges: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",), ordinal: str | None = None) -> DataFrame:
    """A row per range: delivered range, bars, duplicates, missing slots, status (empty, duplicate, unordered, gap, valid)."""
    asked = ranges.select(*keys, "start", "end")
    inside = bars.join(asked, list(keys)).where("time >= start AND time < end")
    counts = inside.groupBy(*keys).agg(
        F.min("time").alias("delivered_start"), (F.max("time_close") + 1).alias("delivered_end"), F.count(F.lit(1)).alias("bars"),
    )
    times = inside.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    missing = missing_slots(bars, asked, timeframe, keys=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    out = asked.join(counts, list(keys), "left").join(times, list(keys), "left").join(missing, list(keys), "left")
    if ordinal:
        stepped = with_previous(inside, keys, ordinal, {"__before": F.col("time")}, chunk_ms=1 << 20)
        out = out.join(stepped.groupBy(*keys).agg(F.count_if(F.col("time") < F.col("__before")).alias("backward")), list(keys), "left")
    else:
        out = out.withColumn("backward", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    status = (
        F.when(zero("bars") == 0, "empty").when(zero("duplicates") > 0, "duplicate").when(zero("backward") > 0, "unordered")
        .when(zero("missing") > 0, "gap").otherwise("valid")
    )
    return out.select(
        *keys, "start", "end", "delivered_start", "delivered_end", zero("bars").alias("bars"), zero("duplicates").alias("duplicates"),
        zero("missing").alias("missing"), status.alias("status"), ((status == "valid")).alias("is_complete"),
    )


def contiguity(bars: DataFrame, ranges: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per range whether its bars are the exact sequence of slots; never for months, which have no fixed grid."""
    if canonical(timeframe) == "1M":
        return ranges.select(*keys, F.lit(False).alias("contiguous"))
    step = milliseconds(timeframe)
    inside = bars.join(ranges.select(*keys, "start", "end"), list(keys)).where("time >= start AND time < end")
    steps = with_previous(inside, keys, "time", {"before": F.col("time")})
    found = steps.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("time") - F.col("before") == step)), F.lit(True)).alias("even"),
        (F.min("time") == F.min("start")).alias("starts"), (F.max("time") + step >= F.min("end")).alias("ends"),
    )
    return ranges.select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce(F.col("even") & F.col("starts") & F.col("ends"), F.lit(False)).alias("contiguous"))


def adjacent_gaps(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per series the number of neighbouring bars that don't touch."""
    steps = with_previous(bars, keys, "time", {"before": F.col("time_close")})
    return steps.groupBy(*keys).agg(F.count_if(F.col("time") != F.col("before") + 1).alias("gaps"))


def is_covered(bars: DataFrame, ranges: DataFrame, timeframe: str, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per range whether every slot has a bar; for months whether there is any bar."""
    if canonical(timeframe) == "1M":
        inside = bars.join(ranges, list(keys)).where("time >= start AND time < end").select(*keys).distinct().withColumn("__any", F.lit(True))
        return ranges.join(inside, list(keys), "left").select(*keys, F.coalesce("__any", F.lit(False)).alias("covered"))
    holes = missing_slots(bars, ranges, timeframe, keys=keys).select(*keys).distinct().withColumn("__hole", F.lit(True))
    return ranges.join(holes, list(keys), "left").select(*keys, F.col("__hole").isNull().alias("covered"))


def touched_days(intervals: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Days (UTC) that the intervals ``[start, end)`` touch: the archive files to read."""
    first, last = (F.to_date(F.timestamp_millis(x)) for x in (F.col("start"), F.col("end") - 1))
    return intervals.where("start < end").select(*keys, F.explode(F.sequence(first, last)).alias("day")).distinct()


def touched_months(intervals: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return touched_days(intervals, keys=keys).select(*keys, F.date_format("day", "yyyy-MM").alias("month")).distinct()
