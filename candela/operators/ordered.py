"""The row before, within a series, without sorting a whole series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A series is cut into chunks of this length; only one row per chunk is ordered over the whole series.
CHUNK_MS = 30 * 86_400_000


def with_previous(
    rows: DataFrame, series: Sequence[str], time: str, carried: dict[str, Column], *, tie: Sequence[str] = (), chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Add columns with the values that ``carried`` has in the row before, by ``time`` then ``tie``, of the same series.

    A window runs in each (series, chunk of time); the first row of a chunk takes the last row of the nearest chunk before,
    which is found among one row per chunk. So a series may be of any length. The first row of a series has nulls.
    """
    values = F.struct(*[value.alias(name) for name, value in carried.items()])
    chunked = rows.withColumn("__chunk", F.floor(F.col(time) / chunk_ms)).withColumn("__own", values)
    order = [time, *tie]
    inside = Window.partitionBy(*series, "__chunk").orderBy(*order)
    rank = F.struct(*order) if tie else F.col(time)
    last = chunked.groupBy(*series, "__chunk").agg(F.max_by("__own", rank).alias("__own"))
    last = last.select(*series, "__chunk", F.lag("__own").over(Window.partitionBy(*series).orderBy("__chunk")).alias("__carried"))
    joined = chunked.withColumns({"__lag": F.lag("__own").over(inside)}).alias("c").join(last.alias("l"), [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*series, "__chunk")], "left")
    previous = F.coalesce("c.__lag", "l.__carried")
    kept = [F.col(f"c.`{c}`") for c in rows.columns]
    return joined.select(*kept, *[previous.getField(name).alias(name) for name in carried])


def with_running_max(rows: DataFrame, series: Sequence[str], time: str, value: str, name: str, *, tie: Sequence[str] = (), chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Add the greatest ``value`` of all rows before, in the same series; null in its first row. Chunked as above."""
    chunked = rows.withColumn("__chunk", F.floor(F.col(time) / chunk_ms))
    before = Window.partitionBy(*series, "__chunk").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)
    most = chunked.groupBy(*series, "__chunk").agg(F.max(value).alias("__most"))
    earlier = Window.partitionBy(*series).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(*series, "__chunk", F.max("__most").over(earlier).alias("__carried"))
    inside = chunked.withColumn("__inside", F.max(value).over(before))
    joined = inside.alias("c").join(most.alias("m"), [F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*series, "__chunk")], "left")
    return joined.select(*[F.col(f"c.`{c}`") for c in rows.columns], F.greatest("c.__inside", "m.__carried").alias(name))
