"""Zipped archives by day and month: which files to read for missing bars, and the bars they hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.timeframe import interval_name
from candela.operators.coverage import missing_slots, touched_days
from candela.operators.merge import keep_last
from candela.plans.query import BarQuery
from candela.sources.offline import read_archives

#: Fixed format of a file's place: market, period, symbol, interval, and the name of the three with the day or month.
PLACE = r"([^/]+)/(daily|monthly)/([^/]+)/([^/]+)/\3-\4-([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.zip$"
SERIES = ("market", "symbol", "interval")


@dataclass(frozen=True)
class Limits:
    """Days up to which a series is read by day, and months up to which by month; beyond both it isn't read. None: no limit."""

    days: int | None = 45
    months: int | None = 12


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``market, symbol, interval, period, date, path`` of the archives below a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root).select("path")
    part = lambda k: F.regexp_extract("path", PLACE, k)
    named = found.where(F.col("path").rlike(PLACE)).select(
        F.lower(part(1)).alias("market"), F.upper(part(3)).alias("symbol"), part(4).alias("interval"), part(2).alias("period"), part(5).alias("date"), "path",
    )
    return named.where(F.length("date") == F.when(F.col("period") == "daily", 10).otherwise(7))


def planned(missing: DataFrame, files: DataFrame, *, keys: Sequence[str] = SERIES, limits: Limits = Limits()) -> DataFrame:
    """A row per series and day that the missing intervals ``[start, end)`` touch: ``day``, and the file to read for it.

    A series that misses few days is read by day, and by month for those days that have no file; one that misses many is
    read by whole months, and by day in months that have no file. ``period`` and ``path`` are null where the listing has
    neither or the limits forbid it. Files are found by equal names; of two with one name the first path is taken.
    """
    days = touched_days(missing, keys=keys).select(*keys, F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "yyyy-MM").alias("month"))
    sizes = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.count_distinct("month").alias("months"))
    named = files.groupBy(*keys, "period", "date").agg(F.min("path").alias("path"))
    by = lambda period, name: named.where(F.col("period") == period).select(*keys, F.col("date").alias(name), F.col("path").alias(period))
    within = lambda name, most: F.lit(True) if most is None else F.col(name) <= most
    placed = days.join(sizes, list(keys)).join(by("daily", "day"), [*keys, "day"], "left").join(by("monthly", "month"), [*keys, "month"], "left")
    few, short = within("days", limits.days), within("months", limits.months)
    choice = F.when(few & F.col("daily").isNotNull(), "daily").when(short & F.col("monthly").isNotNull(), "monthly").when(short & F.col("daily").isNotNull(), "daily")
    return placed.withColumn("period", choice).select(*keys, "day", "period", F.when(F.col("period") == "daily", F.col("daily")).when(F.col("period") == "monthly", F.col("monthly")).alias("path"))


def read_planned(spark: SparkSession, plan: DataFrame, timeframe: str) -> DataFrame | None:
    """The bars of a plan's files, each with its series; a month's bar goes before a day's. The driver holds the files' paths,
    as it does in any scan of files."""
    paths = [r["path"] for r in plan.where("path IS NOT NULL").select("path").distinct().collect()]
    if not paths:
        return None
    part = lambda k: F.regexp_extract("file", PLACE, k)
    rows = read_archives(spark, paths, timeframe).withColumns({"market": F.lower(part(1)), "symbol": F.upper(part(3)), "interval": part(4), "__rank": (part(2) == "monthly").cast("int")})
    return keep_last(rows, [*SERIES, "time"], "__rank").drop("__rank", "file")


def archive_bars(spark: SparkSession, query: BarQuery, *, root: str, limits: Limits = Limits(), files: DataFrame | None = None) -> DataFrame:
    """The closed bars of a query that the archives below ``root`` hold. Where the files of days leave slots open, the months
    of these are read as well. ``files`` is a listing made before."""
    i, name = query.instrument, query.timeframe.canonical
    own = {"market": F.lit(i.market), "symbol": F.lit(i.symbol), "interval": F.lit(interval_name(name, i.exchange))}
    files = listing(spark, root) if files is None else files
    for key, value in own.items():
        files = files.where(F.col(key) == value)
    asked = spark.range(1).select(*[v.alias(k) for k, v in own.items()], F.lit(query.start_ms).alias("start"), F.lit(query.end_ms).alias("end"))
    inside = lambda rows: None if rows is None else rows.where((F.col("time") >= query.start_ms) & (F.col("time") < query.end_ms))
    first = planned(asked, files, limits=limits)
    bars = inside(read_planned(spark, first, name))
    if bars is not None and first.where("period = 'daily'").limit(1).count():
        open_slots = missing_slots(bars, asked, name, keys=SERIES)
        more = inside(read_planned(spark, planned(open_slots, files.where("period = 'monthly'"), limits=limits), name))
        if more is not None:
            bars = keep_last(bars.withColumn("__rank", F.lit(0)).unionByName(more.withColumn("__rank", F.lit(1))), [*SERIES, "time"], "__rank").drop("__rank")
    if bars is None:
        bars = read_archives(spark, [], name).withColumns(own).drop("file")
    made = {"exchange": F.lit(i.exchange), "timeframe": F.lit(name), "source_kind": F.lit(query.source_kind), "source_transport": F.lit("archive"), "provider": F.lit(i.exchange), "is_closed": F.lit(True)}
    return bars.drop("interval").withColumns(made)


def archive_source(spark: SparkSession, root: str, limits: Limits = Limits()):
    """Archives as the source of a provider plan (``plans.provider.fetch``)."""
    return partial(archive_bars, spark, root=root, limits=limits)
