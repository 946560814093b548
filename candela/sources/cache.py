"""A cache of checked bars as CSV: whole segments per series, each with its facts and a checksum that reads are held against."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from candela.errors import InvalidExchangeResponse, UnsupportedFeature
from candela.functions.timeframe import canonical
from candela.operators.quality import bar_violations, guard
from candela.operators.revisions import series_checksum
from candela.plans.query import BarQuery

SERIES = ("exchange", "market", "symbol", "timeframe")
CONTENT = ("time", "open", "high", "low", "close", "volume", "time_close")
_COLUMNS = "time long, open double, high double, low double, close double, volume double, time_close long"
#: What the checksum covers and how the files are laid out; a cache of another layout isn't read.
LAYOUT = 1
_FACTS = StructType([StructField(n, StringType() if n in (*SERIES, "checksum", "part") else LongType()) for n in ("layout", "written", "part", *SERIES, "start", "end", "bars", "first_time", "last_time", "checksum")])


def _facts(bars: DataFrame) -> DataFrame:
    """Of each series: number of bars, first and last time, checksum over the rows in order of time."""
    spans = bars.groupBy(*SERIES).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return series_checksum(bars, CONTENT, keys=SERIES).withColumnRenamed("rows_count", "bars").join(spans, [*SERIES])


@dataclass
class SegmentCache:
    """Segments below ``path``. A write replaces the segments of the series that it holds and leaves the others as they are.

    The bars of a write go into a part of their own, and count once their facts are written; so a write that was cut off
    is never read, and readers see the segment before it. Parts that no segment names any more stay until ``prune``.
    """

    spark: SparkSession
    path: str

    def write(self, bars: DataFrame, *, start: int | None = None, end: int | None = None) -> DataFrame:
        """Write the segments of all series in ``bars`` and return their facts; wrong or repeated bars raise and write nothing.

        Other columns than those of the series and ``CONTENT`` aren't kept. No bars, no segments.
        """
        part = uuid4().hex
        rows = bars.select(*SERIES, *CONTENT)
        spaced = rows.repartitionByRange(*SERIES, "time").sortWithinPartitions(*SERIES, "time")
        spaced.write.partitionBy(*SERIES).option("header", "true").csv(f"{self.path}/part={part}")
        written = self._part(part)
        guard(written, bar_violations(written, keys=SERIES), "a bar to be cached is wrong")
        now = F.unix_millis(F.current_timestamp())
        names = {"layout": F.lit(LAYOUT), "written": now, "part": F.lit(part), "start": F.lit(start).cast("long"), "end": F.lit(end).cast("long")}
        facts = _facts(written).withColumns(names).select(*_FACTS.names)
        facts.write.mode("append").json(f"{self.path}/facts")
        return self.segments().where(F.col("part") == part)

    def segments(self) -> DataFrame:
        """A row per series: the facts of its last write."""
        facts = self.spark.read.schema(_FACTS).json(f"{self.path}/facts")
        last = facts.groupBy(*SERIES).agg(F.max_by(F.struct(*[c for c in _FACTS.names if c not in SERIES]), F.struct("written", "part")).alias("f"))
        return last.select(*SERIES, "f.*").select(*_FACTS.names)

    def _part(self, part: str) -> DataFrame:
        names = ", ".join(f"`{c}` string" for c in SERIES)
        return self.spark.read.schema(f"{_COLUMNS}, {names}").option("header", "true").option("mode", "FAILFAST").csv(f"{self.path}/part={part}")

    def read(self, query: BarQuery, *, max_bars: int | None = None) -> DataFrame:
        """Bars of one series in the query's range by time, the first ``max_bars`` of them.

        The whole segment is held against its facts first, in one pass over it.
        """
        own = {"exchange": query.instrument.exchange, "market": query.instrument.market, "symbol": query.instrument.symbol, "timeframe": canonical(query.timeframe.canonical)}
        rows = self._known()
        for name, value in own.items():
            rows = rows.where(F.col(name) == value)
        found = rows.collect()  # one row at most
        if not found:
            raise UnsupportedFeature(f"no segment of {own}")
        fact = found[0]
        if fact["layout"] != LAYOUT:
            raise InvalidExchangeResponse(f"a segment of layout {fact['layout']}")
        bars = self._part(fact["part"])
        for name, value in own.items():
            bars = bars.where(F.col(name) == value)
        self._hold(bars, rows)
        bars = bars.where((F.col("time") >= query.start_ms) & (F.col("time") < query.end_ms)).orderBy("time")
        return bars if max_bars is None else bars.limit(max_bars)

    def read_all(self) -> DataFrame:
        """Bars of all segments, each held against its facts; a part is read where segments name it."""
        known = self._known()
        guard(known, known.where(F.col("layout") != LAYOUT), "a segment of another layout")
        parts = [f"{self.path}/part={r['part']}" for r in known.select("part").distinct().collect()]  # one per write that still counts
        names = ", ".join(f"`{c}` string" for c in ("part", *SERIES))
        reader = self.spark.read.schema(f"{_COLUMNS}, {names}").option("header", "true").option("mode", "FAILFAST").option("basePath", self.path)
        every = reader.csv(parts) if parts else self.spark.createDataFrame([], f"{_COLUMNS}, {names}")
        bars = every.join(known.select("part", *SERIES), ["part", *SERIES], "left_semi").drop("part")
        self._hold(bars, known)
        return bars

    def _known(self) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/facts")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise UnsupportedFeature(f"no segments at {self.path}")
        return self.segments()

    @staticmethod
    def _hold(bars: DataFrame, known: DataFrame) -> None:
        facts = ("bars", "first_time", "last_time", "checksum")
        seen = _facts(bars).select(*SERIES, *[F.col(c).alias(f"found_{c}") for c in facts])
        torn = known.join(seen, [*SERIES], "left").where(F.array_contains(F.array(*[F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in facts]), False))
        wrong = torn.limit(1).collect()
        if wrong:
            raise InvalidExchangeResponse(f"a segment doesn't match its checksum: {wrong[0].asDict()}")

    def prune(self) -> int:
        """Delete parts that no segment names; returns their number. Not beside writers: what they are at work on is such a part."""
        context = self.spark.sparkContext
        used = {r["part"] for r in self._known().select("part").distinct().collect()}
        root = context._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(context._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("part=") and f.getPath().getName()[5:] not in used]
        for path in old:
            fs.delete(path, True)
        return len(old)
