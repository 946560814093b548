"""Recorded exchange payloads as a Spark data source, for batch reads with pushdown and for streams.

A recording is a folder of batches. A batch is what one run of ``record`` wrote: a folder per page, named after its series and
the range that was asked for, with the payload as one line. Batches are numbered; Spark's marker says that one is whole.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D

from candela.operators.merge import keep_last
from candela.plans.query import TRADE_KLINE, BarQuery
from candela.sources.decode import decode_klines

#: The folders of a page, outermost first, and their kinds.
PAGE = {"batch": int, "exchange": str, "market": str, "symbol": str, "timeframe": str, "start": int, "end": int}
KIND = "batch long, exchange string, market string, symbol string, timeframe string, start long, end long, payload string"
#: Pages that one task reads, unless the option ``pagesPerPartition`` says otherwise.
PAGES = 64

_COMPARED = {
    D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
}


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Pages(D.InputPartition):
    """Folders that one task reads, each with the values of its columns."""

    value: list[tuple[str, tuple]] = field(default_factory=list)


class Listing:
    """The pages of a recording, listed folder by folder; folders that a condition on their column excludes aren't entered."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("pagesPerPartition", PAGES))
        self.conditions: list[tuple[str, object, object]] = []

    def _kept(self, column: str, value: object) -> bool:
        return all(compare(value, bound) for name, compare, bound in self.conditions if name == column)

    def batches(self) -> list[int]:
        fs, root = _opened(self.path)
        found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("batch=")]
        whole = [x for x in found if fs.get_file_info(f"{x.path}/_SUCCESS").type != pyarrow.fs.FileType.NotFound]
        return sorted(int(x.base_name.removeprefix("batch=")) for x in whole)

    def pages(self, batches: Sequence[int]) -> list[tuple[str, tuple]]:
        fs, root = _opened(self.path)
        level = [(f"{root}/batch={k}", (k,)) for k in batches if self._kept("batch", k)]
        for column, kind in list(PAGE.items())[1:]:
            below = []
            for folder, values in level:
                for x in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
                    if x.type == pyarrow.fs.FileType.Directory and x.base_name.startswith(f"{column}="):
                        value = kind(unquote(x.base_name.removeprefix(f"{column}=")))
                        if self._kept(column, value):
                            below.append((x.path, (*values, value)))
            level = below
        return sorted(level, key=lambda x: x[1])

    def partitions_of(self, batches: Sequence[int]) -> list[Pages]:
        pages = self.pages(batches)
        return [Pages(pages[k : k + self.size]) for k in range(0, len(pages), self.size)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        for folder, values in partition.value:
            for file in sorted(fs.get_file_info(pyarrow.fs.FileSelector(folder)), key=lambda x: x.path):
                if not file.base_name.startswith("part-"):
                    continue
                with fs.open_input_stream(file.path) as stream:
                    lines = stream.read().decode().splitlines()
                columns = [pa.array([v] * len(lines), pa.int64() if k is int else pa.string()) for v, k in zip(values, PAGE.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.string())], names=[*PAGE, "payload"])


class KlineReader(Listing, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Conditions on a page's columns are kept here in full, as its folders tell them; others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PAGE and type(f) in _COMPARED and f.value is not None:
                self.conditions.append((name, _COMPARED[type(f)], f.value))
            elif name in PAGE and type(f) is D.In:
                self.conditions.append((name, lambda value, among: value in among, tuple(f.value)))
            elif not (name in PAGE and type(f) is D.IsNotNull):
                yield f

    def partitions(self) -> list[Pages]:
        return self.partitions_of(self.batches())


class KlineStreamReader(Listing, D.DataSourceStreamReader):
    """Offsets are numbers of batches: a stream goes on behind the last batch that its checkpoint names."""

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        return {"batch": max(self.batches(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.partitions_of([k for k in self.batches() if start["batch"] < k <= end["batch"]])


class KlineSource(D.DataSource):
    """``spark.read.format("klines").load(path)`` and ``spark.readStream.format("klines").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)

    def streamReader(self, schema) -> KlineStreamReader:
        return KlineStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KlineSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record(payloads: DataFrame, path: str) -> int:
    """Add a batch of pages ``exchange, market, symbol, timeframe, start, end, payload``; its number.

    ``end`` is the end of the range that was asked for, or the server's time where that came first. One recorder at a time.
    """
    number = max(Listing({"path": path}).batches(), default=0) + 1
    columns = [c for c in PAGE if c != "batch"]
    rows = payloads.select(*columns, F.regexp_replace("payload", r"\s*\n\s*", " ").alias("payload")).repartition(*columns)
    # Static overwriting clears what a failed run left, and leaves the marker of a whole one.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*columns).text(f"{path}/batch={number}")
    return number


def pages_of(spark: SparkSession, path: str, query: BarQuery) -> DataFrame:
    """The pages that can hold bars of the query; no other folder is entered."""
    register(spark)
    i = query.instrument
    same = (F.col("exchange") == i.exchange) & (F.col("market") == i.market) & (F.col("symbol") == i.symbol) & (F.col("timeframe") == query.timeframe.canonical)
    return spark.read.format("klines").load(path).where(same & (F.col("start") < query.end_ms) & (F.col("end") > query.start_ms))


def bars_of_pages(pages: DataFrame, exchange: str, timeframe: str, *, derivative: bool = False) -> DataFrame:
    """Bars of an exchange's pages, batch or stream. A candle is closed if it closed before its page's end."""
    bars = decode_klines(pages, exchange, timeframe, derivative=derivative)
    return bars.withColumn("is_closed", F.col("time_close") < F.col("end")).withColumn("source_kind", F.lit(TRADE_KLINE)).drop("start", "end")


def recorded(spark: SparkSession, path: str, *, derivative: bool = False):
    """A source of bars, as the provider plan asks for them. Of a candle that several pages hold a closed one counts, else the
    one recorded last."""

    def get(query: BarQuery) -> DataFrame:
        bars = bars_of_pages(pages_of(spark, path, query), query.instrument.exchange, query.timeframe.canonical, derivative=derivative).where(query.predicate())
        placed = bars.withColumn("__place", F.struct("is_closed", "batch"))
        return keep_last(placed, ["exchange", "market", "symbol", "timeframe", "time"], "__place").drop("__place", "batch")

    return get
