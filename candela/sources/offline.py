"""Files of bars: CSV with aliased headers, Parquet, zipped archives, raw payloads, exports."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.errors import from_jobs, UnsupportedFeature, ValidationError
from candela.functions.timeframe import bucket, canonical, close_time, micros_to_ms
from candela.operators.quality import bar_violations, guard, text_violations
from candela.operators.resample import merge_same_open
from candela.plans.query import Instrument

#: Header names that stand for the same column.
ALIASES = {"time": ("time", "timestamp", "open_time"), "time_close": ("time_close", "close_time")}


def _named(raw: DataFrame, name: str):
    found = [c for c in ALIASES.get(name, (name,)) if c in raw.columns]
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in found]) if found else F.lit(None).cast("string")


def _number(value, kind: str, name: str):
    """A number of a file: null where nothing is given, an error with a code where it is no number."""
    wrong = F.raise_error(F.concat(F.lit(f"MD_VALIDATION_ERROR: {name} is no {kind}: "), value.cast("string"))).cast(kind)
    return F.when(value.isNotNull(), F.coalesce(value.try_cast(kind), wrong))


def _checked(bars: DataFrame) -> DataFrame:
    """Bars by time. A repeated or missing time, a missing price and a bar that is no candle raise ``ValidationError``."""
    with from_jobs():
        guard(bars, bars.where(F.col("time").isNull()), "a bar has no time")
        guard(bars, bar_violations(bars.withColumn("symbol", F.lit("-"))), "a bar of the file is wrong")
    return bars.orderBy("time")


def read_bars_csv(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """``time`` (or an alias), prices, optional ``volume`` (0) and close time (computed); nothing else is read.

    Rows come by time and checked: see ``_checked``, whose look for a first wrong bar is an action. An empty file has no bars.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if not set(ALIASES["time"]) & set(raw.columns):
        raise ValidationError(f"no time column in {path}")
    prices = [_number(_named(raw, n), "double", n).alias(n) for n in ("open", "high", "low", "close")]
    volume = F.coalesce(_number(_named(raw, "volume"), "double", "volume"), F.lit(0.0)).alias("volume")
    rows = raw.select(_number(_named(raw, "time"), "long", "time").alias("time"), *prices, volume, _number(_named(raw, "time_close"), "long", "close time").alias("time_close"))
    return _checked(rows.withColumn("time_close", F.coalesce("time_close", close_time(F.col("time"), timeframe))))


def read_bars_parquet(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """As ``read_bars_csv``, of Parquet and without aliases; a column may have any type that casts to its number."""
    raw = spark.read.parquet(path)
    lacking = [c for c in ("time", "open", "high", "low", "close") if c not in raw.columns]
    if lacking:
        raise ValidationError(f"no {lacking[0]} column in {path}")
    given = lambda name, kind: _number(F.col(name), kind, name) if name in raw.columns else F.lit(None).cast(kind)
    rows = raw.select(given("time", "long").alias("time"), *[given(c, "double").alias(c) for c in ("open", "high", "low", "close")],
                      F.coalesce(given("volume", "double"), F.lit(0.0)).alias("volume"), given("time_close", "long").alias("time_close"))
    return _checked(rows.withColumn("time_close", F.coalesce("time_close", close_time(F.col("time"), timeframe))))


def read_bars(spark: SparkSession, path: str, timeframe: str, *, start: int | None = None, end: int | None = None, max_bars: int | None = None) -> DataFrame:
    """Bars of a CSV or Parquet file or folder, as its name ends, in ``[start, end)``; the first ``max_bars`` of them."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet"):
        raise UnsupportedFeature(f"can't read {path}")
    bars = (read_bars_csv if kind == "csv" else read_bars_parquet)(spark, path, timeframe)
    bars = bars if start is None else bars.where(F.col("time") >= start)
    bars = bars if end is None else bars.where(F.col("time") < end)
    return bars if max_bars is None else head(bars, max_bars)


#: Columns that a file of canonical bars must have.
STRICT = ("time", "open", "high", "low", "close", "volume", "time_close", "finality", "provider", "provider_revision", "revision_state", "revision")


def read_canonical_csv(spark: SparkSession, path: str, *, instrument: Instrument, timeframe: str, final_only: bool = True) -> DataFrame:
    """Bars with provenance and the exact decimal texts of their prices, for repairs and snapshots.

    Every column of ``STRICT`` must be there and filled; prices must be exact decimals that make a candle, the close time that
    of the timeframe, the provider the exchange, and one provider revision hold for the file. ``final_only`` refuses open bars.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    lacking = [c for c in STRICT if c not in raw.columns]
    if lacking:
        raise ValidationError(f"{path} has no {', '.join(lacking)}")
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in STRICT}
    rows = raw.select(
        text["time"].try_cast("long").alias("time"), *[text[c].try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        text["time_close"].try_cast("long").alias("time_close"), F.lit(instrument.exchange).alias("exchange"), F.lit(instrument.market).alias("market"),
        F.lit(instrument.symbol).alias("symbol"), F.lit(canonical(timeframe)).alias("timeframe"), F.upper(text["finality"]).alias("finality"),
        F.lower(text["provider"]).alias("provider"), text["provider_revision"].alias("provider_revision"), F.upper(text["revision_state"]).alias("revision_state"),
        text["revision"].try_cast("long").alias("revision"), *[text[c].alias(f"{c}_text") for c in ("open", "high", "low", "close", "volume")],
    ).withColumn("is_closed", F.col("finality") == "FINAL")
    empty = F.greatest(*[F.col(c).isNull().cast("int") for c in rows.columns]) == 1
    wrong = empty | (F.col("provider") != instrument.exchange) | (F.col("time_close") != close_time(F.col("time"), timeframe)) | ~F.col("finality").isin("FINAL", "OPEN")
    wrong = wrong | ~F.col("revision_state").isin("ORIGINAL", "CORRECTED", "REVOKED") | ((F.col("revision_state") == "ORIGINAL") != (F.col("revision") == 0))
    if final_only:
        wrong = wrong | (F.col("finality") != "FINAL")
    guard(rows, rows.where(wrong), "a row isn't canonical")
    guard(rows, text_violations(rows), "a row is no candle")
    guard(rows, rows.agg(F.count_distinct("provider_revision").alias("n")).where("n > 1"), "several provider revisions")
    return rows


def head(bars: DataFrame, count: int) -> DataFrame:
    """The first bars by time."""
    return bars.orderBy("time").limit(count)


#: Bytes of text that are unpacked at once.
CHUNK = 4 << 20


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbered lines of each file's first CSV member, a few megabytes at a time."""
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    member = next((m for m in archive.namelist() if m.endswith(".csv")), None)
                    if member is None:
                        continue
                    at = 0
                    with io.TextIOWrapper(archive.open(member), encoding="utf-8") as stream:
                        while lines := stream.readlines(CHUNK):
                            place = pa.array(range(at, at + len(lines)), pa.int64())
                            yield pa.RecordBatch.from_pydict({"file": pa.repeat(name, len(lines)), "ordinal": place, "line": pa.array(lines, pa.string())})
                            at += len(lines)
            except (zipfile.BadZipFile, zlib.error, UnicodeDecodeError, EOFError) as error:
                raise ValueError(f"MD_INVALID_EXCHANGE_RESPONSE: {name} can't be unpacked: {error}") from error


def read_archives(spark: SparkSession, path: str | Sequence[str], timeframe: str, *, start: int | None = None, end: int | None = None) -> DataFrame:
    """Zipped kline CSV files: header rows skipped, microseconds as ms, open times floored, rows of one open time merged.

    A file is unpacked by one task as a stream, its rows keep their number, so the first and last of an open time are certain.
    A file that can't be unpacked and a row whose prices are no numbers stop the job with ``MD_INVALID_EXCHANGE_RESPONSE``.
    """
    if isinstance(path, str) or path:
        files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")
    else:
        files = spark.createDataFrame([], "path string, content binary")
    lines = files.mapInArrow(_unpacked, "file string, ordinal long, line string").withColumn("f", F.split(F.rtrim("line"), ","))
    text = {n: F.trim(F.get("f", F.lit(k + 1))) for k, n in enumerate(("open", "high", "low", "close", "volume"))}
    bent = F.raise_error(F.concat(F.lit("MD_INVALID_EXCHANGE_RESPONSE: no candle in "), "file", F.lit(": "), "line")).cast("double")
    rows = lines.withColumn("time", F.trim(F.get("f", F.lit(0))).try_cast("long")).where("time IS NOT NULL").select(
        "file", "ordinal", "time", *[F.coalesce(t.try_cast("double"), bent).alias(n) for n, t in text.items()], *[t.alias(f"{n}_text") for n, t in text.items()],
    )
    at = bucket(micros_to_ms(F.col("time")), timeframe)
    if start is not None:
        rows = rows.where(at >= start)
    if end is not None:
        rows = rows.where(at < end)
    merged = merge_same_open(rows, timeframe, keys=("file",))
    return merged.withColumn("time_close", close_time(F.col("time"), timeframe))


def write_raw(payloads: DataFrame, path: str, *, column: str = "payload", partition: str | None = None, compression: str | None = None) -> None:
    """Payloads as compact JSON lines, a folder per partition value; batches are appended and never overwrite another's files."""
    writer = payloads.select(F.col(column).alias("value"), *([partition] if partition else [])).write.mode("append")
    writer = writer.partitionBy(partition) if partition else writer
    (writer.option("compression", compression) if compression else writer).text(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=False).withColumnRenamed("value", "payload")


def export(bars: DataFrame, path: str, kind: str = "csv") -> None:
    if kind not in ("csv", "json"):
        raise ValidationError(f"can't export {kind}")
    bars.write.mode("errorifexists").format(kind).option("header", "true").save(path)
