"""Registered queries over the given tables, each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.errors import ValidationError
from candela.functions import hashing, identity, timeframe
from candela.operators import coverage, footprint, merge, projections, quality, resample, revisions, symbols
from candela.plans import archives, derived
from candela.plans.query import BarQuery, FootprintQuery, Instrument, in_range
from candela.plans.trades import TradeCache, cached_footprint
from candela.sources import decode, recorded, tables
from candela.sources.cache import SegmentCache
from candela.store import BarStore, SnapshotStore
from candela.streaming import klines, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR = timeframe.HOUR
CUTOFF = 1705708800000  # 2024-01-20
SERVER = 1706000000000

TRADES = """trades AS (
  SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS time, epoch_us(ts) AS micros, value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity, (user_id % 2 = 1) AS buyer_maker, upper(event_type) AS symbol
  FROM events)"""
BARS = TRADES + """, bars AS (
  SELECT symbol, (time // 3600000) * 3600000 AS time, arg_min(price, micros) AS open, max(price) AS high, min(price) AS low, arg_max(price, micros) AS close,
         CAST(sum(quantity) AS DOUBLE) AS volume, count(*) AS trades_count, (time // 3600000) * 3600000 + 3599999 AS time_close
  FROM trades GROUP BY symbol, (time // 3600000))"""
TICKS = """ticks AS (
  SELECT o_orderpriority AS symbol, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS time, o_totalprice AS price, o_orderdate AS day,
         CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 AS BIGINT) * 10000000000 + o_orderkey AS micros FROM orders)"""
RANGES = BARS + ", ranges AS (SELECT symbol, min(time) AS start, max(time) + 3600000 AS fin FROM bars GROUP BY symbol)"
PAIR = BARS + """, marked AS (
  SELECT symbol, time, open, high, low, close, volume, time // 3600000 AS slot FROM bars
), source AS (SELECT symbol, time, open, high, low, close, volume FROM marked
), store AS (
  SELECT symbol, time, open, high, low, CASE WHEN slot % 13 = 0 THEN close + 1 ELSE close END AS close, volume FROM marked WHERE slot % 17 <> 0
  UNION ALL SELECT symbol, time + 1800000, open, high, low, close, volume FROM marked WHERE slot % 97 = 0)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = tables.bars_1h(spark, sf_dir).select("symbol", "time", "open", "high", "low", "close", "volume")
    slot = F.floor(F.col("time") / HOUR)
    changed = source.where(slot % 17 != 0).withColumn("close", F.when(slot % 13 == 0, F.col("close") + 1).otherwise(F.col("close")))
    shifted = source.where(slot % 97 == 0).withColumn("time", F.col("time") + HOUR // 2)
    return source, changed.unionByName(shifted)


# --- bars from trades and from bars ------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT * FROM bars")
def ohlcv_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_1h(spark, sf_dir)


def _resampled_sql(ms: int, extra: str = "") -> str:
    return f"""WITH {BARS} SELECT symbol, (time // {ms}) * {ms} AS time,
       coalesce(arg_min(open, time) FILTER (WHERE volume > 0), arg_min(open, time)) AS open, max(high) AS high, min(low) AS low,
       coalesce(arg_max(close, time) FILTER (WHERE volume > 0), arg_max(close, time)) AS close, sum(volume) AS volume,
       (time // {ms}) * {ms} + {ms - 1} AS time_close{extra} FROM bars GROUP BY symbol, time // {ms}"""


@query(_resampled_sql(4 * HOUR))
def resample_4h_from_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(tables.bars_1h(spark, sf_dir), "4h")


@query(_resampled_sql(24 * HOUR))
def resample_1d_from_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(tables.bars_1h(spark, sf_dir), "1D")


def _calendar_sql(unit: str) -> str:
    return f"""WITH {TICKS} SELECT symbol, epoch_ms(date_trunc('{unit}', CAST(day AS TIMESTAMP))) AS time, arg_min(price, micros) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, micros) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades_count,
       epoch_ms(date_trunc('{unit}', CAST(day AS TIMESTAMP)) + INTERVAL 1 {unit}) - 1 AS time_close
       FROM ticks GROUP BY symbol, date_trunc('{unit}', CAST(day AS TIMESTAMP))"""


@query(_calendar_sql("week"))
def resample_week_monday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bars_from_trades(tables.ticks(spark, sf_dir), "1W")


@query(_calendar_sql("month"))
def resample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bars_from_trades(tables.ticks(spark, sf_dir), "1M")


@query(f"""WITH {TICKS} SELECT symbol, (time // 604800000) * 604800000 AS time, max(price) AS high, min(price) AS low, count(*) AS trades_count
       FROM ticks GROUP BY symbol, time // 604800000""")
def resample_week_epoch_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bars_from_trades(tables.ticks(spark, sf_dir), "1W", anchor="epoch").select("symbol", "time", "high", "low", "trades_count")


@query(f"""WITH {BARS}, quiet AS (SELECT symbol, time, open, close, CASE WHEN (time // 3600000) % 3 = 0 THEN 0.0 ELSE volume END AS volume FROM bars)
       SELECT symbol, (time // 14400000) * 14400000 AS time, coalesce(arg_min(open, time) FILTER (WHERE volume > 0), arg_min(open, time)) AS open,
       coalesce(arg_max(close, time) FILTER (WHERE volume > 0), arg_max(close, time)) AS close FROM quiet GROUP BY symbol, time // 14400000""")
def first_traded_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = F.when(F.floor(F.col("time") / HOUR) % 3 == 0, F.lit(0.0)).otherwise(F.col("volume"))
    return resample.resample(tables.bars_1h(spark, sf_dir).withColumn("volume", quiet), "4h").select("symbol", "time", "open", "close")


@query(f"""WITH {TRADES} SELECT symbol, CAST(sum(CAST(price AS DECIMAL(18,2)) * quantity) AS DOUBLE) AS notional, CAST(sum(quantity) AS BIGINT) AS volume FROM trades GROUP BY symbol""")
def exact_decimal_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    notional = F.sum(F.col("price").cast("decimal(18,2)") * F.col("quantity"))
    return tables.trades(spark, sf_dir).groupBy("symbol").agg(notional.cast("double").alias("notional"), F.sum("quantity").alias("volume"))


@query(f"""WITH {BARS} SELECT symbol, (time // 14400000) * 14400000 AS time, CAST(max(high) AS DECIMAL(18,2))::VARCHAR AS high_text, CAST(min(low) AS DECIMAL(18,2))::VARCHAR AS low_text,
       CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY symbol, time // 14400000""")
def exact_text_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"open": "open_text", "high": "high_text", "low": "low_text", "close": "close_text", "volume": "volume_text"}
    texts = tables.bars_1h(spark, sf_dir).withColumns({t: F.col(n).cast("decimal(18,2)").cast("string") for n, t in names.items()})
    return resample.resample_exact(texts, "4h").select("symbol", "time", "high_text", "low_text", F.col("volume_exact").cast("double").alias("volume"))


@query(f"""WITH {TRADES}, rows AS (SELECT symbol, time // 60000 * 60000 AS time, price, quantity, micros FROM trades)
       SELECT symbol, (time // 3600000) * 3600000 AS time, arg_min(price, micros) AS open, max(price) AS high, min(price) AS low, arg_max(price, micros) AS close, CAST(sum(quantity) AS DOUBLE) AS volume
       FROM rows GROUP BY symbol, time // 3600000""")
def archive_same_open_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("price")
    rows = tables.trades(spark, sf_dir).select(
        "symbol", (F.col("time") * 1000).alias("time"), *[price.alias(n) for n in ("open", "high", "low", "close")], F.col("quantity").alias("volume"), F.col("micros").alias("ordinal"),
    )
    return resample.merge_same_open(rows, "1h")


@query("""SELECT DISTINCT epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS time, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + 86399999 AS day_close,
       epoch_ms(date_trunc('week', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 7 DAY) - 1 AS week_close,
       epoch_ms(date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 1 MONTH) - 1 AS month_close,
       epoch_ms(date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 1 MONTH) AS next_month FROM orders""")
def close_time_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.ticks(spark, sf_dir).select("time").distinct()
    at = F.col("time")
    close = timeframe.close_time
    return days.select("time", close(at, "1D").alias("day_close"), close(at, "1W").alias("week_close"), close(at, "1M").alias("month_close"), timeframe.next_open(at, "1M").alias("next_month"))


@query("""WITH names AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'D' WHEN 1 THEN 'M' WHEN 2 THEN 'w' WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN CAST(p_size AS VARCHAR) || 'M'
         WHEN 5 THEN CAST(p_size AS VARCHAR) || 'h' WHEN 6 THEN CAST(p_size AS VARCHAR) || 'x' ELSE ' 0' || CAST(p_size AS VARCHAR) || 'S ' END AS name, p_size AS n, p_partkey % 8 AS k FROM part),
       known AS (SELECT *, CASE WHEN k = 0 THEN '1D' WHEN k = 1 OR (k = 4 AND n = 1) THEN '1M' WHEN k = 2 THEN '1W' WHEN k IN (3, 4) THEN n || 'm' WHEN k = 5 THEN n || 'h' WHEN k = 7 THEN n || 's' END AS canonical FROM names)
       SELECT p_partkey, name, canonical, CAST(CASE WHEN k = 0 THEN 86400000 WHEN canonical = '1M' THEN NULL WHEN k = 2 THEN 604800000 WHEN k IN (3, 4) THEN n * 60000 WHEN k = 5 THEN n * 3600000 WHEN k = 7 THEN n * 1000 END AS BIGINT) AS length_ms FROM known""")
def timeframe_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    forms = [F.lit("D"), F.lit("M"), F.lit("w"), n, F.concat(n, F.lit("M")), F.concat(n, F.lit("h")), F.concat(n, F.lit("x")), F.concat(F.lit(" 0"), n, F.lit("S "))]
    name = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)])
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", timeframe.canonical_column(F.col("name")).alias("canonical"), timeframe.milliseconds_column(F.col("name")).alias("length_ms"))


@query(f"""WITH {TRADES}, mixed AS (SELECT trade_id, time, micros, CASE trade_id % 3 WHEN 0 THEN time // 1000 WHEN 1 THEN time ELSE micros END AS raw FROM trades)
       SELECT trade_id, CASE WHEN raw >= 100000000000000 THEN raw // 1000 WHEN raw <= 1000000000000 THEN raw * 1000 ELSE raw END AS time, strftime(make_timestamp(micros), '%Y-%m-%d') AS day FROM mixed""")
def epoch_unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("trade_id") % 3
    raw = F.when(k == 0, F.floor(F.col("time") / 1000)).when(k == 1, F.col("time")).otherwise(F.col("micros"))
    rows = tables.trades(spark, sf_dir).withColumn("raw", raw)
    return rows.select("trade_id", timeframe.epoch_ms(timeframe.micros_to_ms(F.col("raw"))).alias("time"), F.date_format(F.timestamp_micros("micros"), "yyyy-MM-dd").alias("day"))


# --- filters and quality -----------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT symbol, time, CASE WHEN {SERVER} >= time_close THEN 'FINAL' ELSE 'OPEN' END AS finality FROM bars")
def finality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_1h(spark, sf_dir).select("symbol", "time", quality.finality(F.col("time_close"), SERVER).alias("finality"))


@query(f"WITH {BARS} SELECT symbol, time, close FROM bars WHERE time_close <= {SERVER}")
def exclude_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exclude_open(tables.bars_1h(spark, sf_dir), SERVER).select("symbol", "time", "close")


@query(f"WITH {TRADES} SELECT trade_id, time, price FROM trades WHERE time >= {CUTOFF - 5 * 24 * HOUR} AND time < {CUTOFF}")
def range_scan_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = in_range(tables.table(spark, sf_dir, "events"), CUTOFF - 5 * 24 * HOUR, CUTOFF, stored="ts")
    return events.select(F.col("event_id").alias("trade_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("value").alias("price"))


@query(f"WITH {BARS} SELECT symbol, time, open FROM bars ORDER BY time, symbol LIMIT 100")
def head_n_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_1h(spark, sf_dir).select("symbol", "time", "open").orderBy("time", "symbol").limit(100)


@query(f"""WITH {BARS}, bent AS (SELECT symbol, CASE WHEN (time // 3600000) % 31 = 0 THEN time - 3600000 ELSE time END AS time, open, CASE WHEN (time // 3600000) % 7 = 0 THEN open - 1 ELSE high END AS high, low, close,
           CASE WHEN (time // 3600000) % 11 = 0 THEN -1.0 ELSE volume END AS volume, CASE WHEN (time // 3600000) % 13 = 0 THEN time - 3600001 ELSE time_close END AS time_close FROM bars),
       numbered AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY time, open, high, low, close) AS before FROM bent)
       SELECT symbol, time, 'duplicate' AS rule FROM numbered WHERE before = time UNION ALL SELECT symbol, time, 'high' FROM numbered WHERE high < greatest(open, close)
       UNION ALL SELECT symbol, time, 'low' FROM numbered WHERE low > least(open, close) UNION ALL SELECT symbol, time, 'close_time' FROM numbered WHERE time_close < time
       UNION ALL SELECT symbol, time, 'volume' FROM numbered WHERE volume < 0""")
def bar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.col("time") / HOUR)
    bars = tables.bars_1h(spark, sf_dir).withColumns(
        {
            "high": F.when(slot % 7 == 0, F.col("open") - 1).otherwise(F.col("high")),
            "volume": F.when(slot % 11 == 0, F.lit(-1.0)).otherwise(F.col("volume")),
            "time_close": F.when(slot % 13 == 0, F.col("time") - HOUR - 1).otherwise(F.col("time_close")),
            "time": F.when(slot % 31 == 0, F.col("time") - HOUR).otherwise(F.col("time")),
        }
    )
    return quality.bar_violations(bars)


# --- coverage ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {RANGES}, grid AS (SELECT symbol, unnest(range(start, fin, 3600000)) AS time FROM ranges)
       SELECT g.symbol, g.time AS start, g.time + 3600000 AS "end" FROM grid g ANTI JOIN bars b ON g.symbol = b.symbol AND g.time = b.time""")
def missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    return coverage.missing_slots(bars, coverage.series_ranges(bars, "1h"), "1h")


@query(f"""WITH {RANGES}, walked AS (SELECT symbol, time, max(time_close + 1) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM bars)
       SELECT symbol, reached AS start, time AS "end" FROM walked WHERE reached < time
       UNION ALL SELECT r.symbol, max(b.time_close) + 1, max(r.fin) + 7200000 FROM ranges r JOIN bars b ON r.symbol = b.symbol GROUP BY r.symbol""")
def coalesced_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    return coverage.coalesced_gaps(bars, coverage.series_ranges(bars, "1h").withColumn("end", F.col("end") + 2 * HOUR))


@query(f"""WITH {BARS}, flagged AS (SELECT symbol, time, time_close, CASE WHEN time <= lag(time_close) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)),
       grouped AS (SELECT symbol, time, time_close, sum(fresh) OVER (PARTITION BY symbol ORDER BY time) AS g FROM flagged)
       SELECT symbol, min(time) AS start, max(time_close) + 1 AS "end" FROM grouped GROUP BY symbol, g""")
def coverage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.islands(tables.bars_1h(spark, sf_dir))


@query(f"""WITH {RANGES}, n AS (SELECT symbol, count(*) AS bars, min(time) AS a, max(time_close) + 1 AS b FROM bars GROUP BY symbol)
       SELECT r.symbol, r.start, r.fin AS "end", n.a AS delivered_start, n.b AS delivered_end, n.bars, CAST(0 AS BIGINT) AS duplicates, (r.fin - r.start) // 3600000 - n.bars AS missing,
       CASE WHEN (r.fin - r.start) // 3600000 > n.bars THEN 'gap' ELSE 'valid' END AS status, (r.fin - r.start) // 3600000 = n.bars AS is_complete FROM ranges r JOIN n ON r.symbol = n.symbol""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    return coverage.coverage_report(bars, coverage.series_ranges(bars, "1h"), "1h")


@query(f"""WITH {RANGES}, s AS (SELECT symbol, time, lag(time) OVER (PARTITION BY symbol ORDER BY time) AS before FROM bars)
       SELECT symbol, bool_and(before IS NULL OR time - before = 3600000) AS contiguous FROM s GROUP BY symbol""")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    return coverage.contiguity(bars, coverage.series_ranges(bars, "1h"), "1h")


@query(f"""WITH {BARS}, s AS (SELECT symbol, time, lag(time_close) OVER (PARTITION BY symbol ORDER BY time) AS before FROM bars)
       SELECT symbol, count(*) FILTER (WHERE time <> before + 1) AS gaps FROM s GROUP BY symbol""")
def adjacent_gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.adjacent_gaps(tables.bars_1h(spark, sf_dir))


@query(f"""WITH {RANGES}, grid AS (SELECT symbol, unnest(range(start, fin, 3600000)) AS time FROM ranges),
       holes AS (SELECT g.symbol, g.time FROM grid g ANTI JOIN bars b ON g.symbol = b.symbol AND g.time = b.time)
       SELECT DISTINCT symbol, strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS day FROM holes""")
def archive_days_for_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    return coverage.touched_days(coverage.missing_slots(bars, coverage.series_ranges(bars, "1h"), "1h")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""WITH {TICKS}, d AS (SELECT DISTINCT symbol, CAST(day AS DATE) AS day FROM ticks), named AS (SELECT symbol, year(day) || '-' || CASE WHEN month(day) <= 6 THEN '1' ELSE '2' END AS half, day FROM d),
       ranges AS (SELECT DISTINCT symbol, half, make_date(year(day), CASE WHEN month(day) <= 6 THEN 1 ELSE 7 END, 1) AS a FROM named),
       grid AS (SELECT symbol, half, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(a AS TIMESTAMP) + INTERVAL 6 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM ranges),
       holes AS (SELECT g.* FROM grid g ANTI JOIN d ON g.symbol = d.symbol AND g.day = d.day), sizes AS (SELECT symbol, half, count(*) AS n FROM holes GROUP BY ALL),
       daily AS (SELECT DISTINCT symbol, half, CAST(day + 1 AS DATE) AS day FROM named), monthly AS (SELECT DISTINCT symbol, half, strftime(day, '%Y-%m') AS month FROM named WHERE month(day) % 4 <> 0),
       choice AS (SELECT h.symbol, h.half, h.day, strftime(h.day, '%Y-%m') AS month, f.day IS NOT NULL AS has_day, m.month IS NOT NULL AS has_month, s.n <= 45 AS few FROM holes h JOIN sizes s USING (symbol, half)
         LEFT JOIN daily f ON f.symbol = h.symbol AND f.half = h.half AND f.day = h.day LEFT JOIN monthly m ON m.symbol = h.symbol AND m.half = h.half AND m.month = strftime(h.day, '%Y-%m'))
       SELECT symbol, half, strftime(day, '%Y-%m-%d') AS day, CASE WHEN few AND has_day THEN 'daily' WHEN has_month THEN 'monthly' WHEN has_day THEN 'daily' END AS period,
       CASE WHEN few AND has_day THEN strftime(day, '%Y-%m-%d') WHEN has_month THEN month WHEN has_day THEN strftime(day, '%Y-%m-%d') END AS path FROM choice""")
def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of days and months for the days that half-years of order totals miss; a day's file stands where the day before has an order."""
    at, keys = F.col("at"), ("symbol", "half")
    days = tables.ticks(spark, sf_dir).select("symbol", F.timestamp_millis("time").alias("at")).distinct()
    days = days.withColumn("half", F.concat_ws("-", F.year(at), F.when(F.month(at) <= 6, 1).otherwise(2)))
    first = F.make_timestamp(F.year(at), F.when(F.month(at) <= 6, 1).otherwise(7), *[F.lit(k) for k in (1, 0, 0, 0)])
    ranges = days.select(*keys, F.unix_millis(first).alias("start"), F.unix_millis(F.add_months(first, 6).cast("timestamp")).alias("end")).distinct()
    missing = coverage.missing_slots(days.select(*keys, F.unix_millis("at").alias("time")), ranges, "1D", keys=keys)
    names = {"daily": F.date_format(F.date_add(at, 1), "yyyy-MM-dd"), "monthly": F.when(F.month(at) % 4 != 0, F.date_format(at, "yyyy-MM"))}
    files = reduce(DataFrame.unionByName, [days.select(*keys, F.lit(p).alias("period"), n.alias("date"), n.alias("path")).where("date IS NOT NULL") for p, n in names.items()])
    return archives.planned(missing, files, keys=keys)


# --- footprints --------------------------------------------------------------------------------------------------------

LEVELS = TRADES + """, levels AS (SELECT symbol, (time // 3600000) * 3600000 AS time, floor(price / CAST(10 AS DOUBLE)) * CAST(10 AS DOUBLE) AS price_low,
  CAST(coalesce(sum(quantity) FILTER (WHERE NOT buyer_maker), 0) AS DOUBLE) AS buy_volume, CAST(coalesce(sum(quantity) FILTER (WHERE buyer_maker), 0) AS DOUBLE) AS sell_volume,
  count(*) FILTER (WHERE NOT buyer_maker) AS buy_count, count(*) FILTER (WHERE buyer_maker) AS sell_count FROM trades GROUP BY ALL)"""


@query(f"WITH {LEVELS} SELECT symbol, time, time + 3600000 AS time_close, price_low, price_low + 10 AS price_high, buy_volume, sell_volume, buy_count, sell_count FROM levels")
def footprint_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprint.footprint_levels(tables.trades(spark, sf_dir), "1h", 10.0).drop("total_volume", "volume_delta")


@query(f"WITH {LEVELS} SELECT symbol, time, CAST(sum(buy_count + sell_count) AS BIGINT) AS trades_count, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, count(*) AS levels FROM levels GROUP BY symbol, time")
def footprint_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = footprint.footprint_bars(footprint.footprint_levels(tables.trades(spark, sf_dir), "1h", 10.0))
    return bars.select("symbol", "time", "trades_count", "buy_volume", "sell_volume", F.size("levels").cast("long").alias("levels"))


@query(f"WITH {LEVELS} SELECT symbol, time, price_low, buy_volume + sell_volume AS total_volume, buy_volume - sell_volume AS volume_delta FROM levels")
def footprint_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprint.footprint_levels(tables.trades(spark, sf_dir), "1h", 10.0).select("symbol", "time", "price_low", "total_volume", "volume_delta")


# --- merges ------------------------------------------------------------------------------------------------------------

OVERLAP = TRADES + """, keyed AS (SELECT symbol, (time // 600000) * 600000 AS slot, trade_id, price FROM trades)"""


@query(f"WITH {OVERLAP} SELECT symbol, slot, trade_id, price FROM keyed QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY trade_id DESC) = 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.trades(spark, sf_dir).select("symbol", timeframe.bucket(F.col("time"), "10m").alias("slot"), "trade_id", "price")
    return merge.keep_last(rows, ["symbol", "slot"], "trade_id")


@query(f"WITH {OVERLAP} SELECT symbol, slot, trade_id, price FROM keyed QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY trade_id) = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.trades(spark, sf_dir).select("symbol", timeframe.bucket(F.col("time"), "10m").alias("slot"), "trade_id", "price")
    return merge.keep_first(rows, ["symbol", "slot"], "trade_id")


@query(f"""WITH {TRADES}, both_ AS (SELECT trade_id, time, price, 0 AS p FROM trades WHERE time < {CUTOFF} UNION ALL SELECT trade_id, time, price + 1, 1 FROM trades WHERE time >= {CUTOFF - 24 * HOUR})
       SELECT trade_id, time, price FROM both_ QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY p DESC) = 1""")
def source_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.trades(spark, sf_dir).select("trade_id", "time", "price")
    rest = rows.where(F.col("time") >= CUTOFF - 24 * HOUR).withColumn("price", F.col("price") + 1)
    return merge.prefer_later([rows.where(F.col("time") < CUTOFF), rest], ["trade_id"])


_ISSUES = """SELECT a.symbol, a.time, CASE WHEN b.symbol IS NULL THEN 'missing' ELSE 'mismatch' END AS kind FROM source a LEFT JOIN store b ON a.symbol = b.symbol AND a.time = b.time
  WHERE b.symbol IS NULL OR (a.open, a.high, a.low, a.close, a.volume) IS DISTINCT FROM (b.open, b.high, b.low, b.close, b.volume)"""


@query(f"WITH {PAIR} {_ISSUES}")
def audit_nonstrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.audit(*_pair(spark, sf_dir))


@query(f"WITH {PAIR} {_ISSUES} UNION ALL SELECT s.symbol, s.time, 'extra' FROM store s ANTI JOIN source a ON a.symbol = s.symbol AND a.time = s.time")
def audit_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.audit(*_pair(spark, sf_dir), strict=True)


@query(f"WITH {PAIR} SELECT * FROM source")
def repair_merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.repaired(*_pair(spark, sf_dir), strict=True)


@query(f"WITH {PAIR} SELECT * FROM source UNION ALL SELECT s.* FROM store s ANTI JOIN source a ON a.symbol = s.symbol AND a.time = s.time")
def repair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.repaired(*_pair(spark, sf_dir))


@query(f"""WITH {PAIR} SELECT a.symbol, a.time, CASE WHEN b.symbol IS NULL THEN 'new' WHEN (a.open, a.high, a.low, a.close, a.volume) IS NOT DISTINCT FROM (b.open, b.high, b.low, b.close, b.volume) THEN 'duplicate'
       ELSE 'conflict' END AS outcome FROM source a LEFT JOIN store b ON a.symbol = b.symbol AND a.time = b.time""")
def bulk_write_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.classify_bulk(*_pair(spark, sf_dir)).select("symbol", "time", "outcome")


_WIDE = """wide AS (SELECT symbol, time, open, high, low, close, volume, time_close, trades_count, 'rest' AS source_transport FROM bars),
  other AS (SELECT * REPLACE (CASE WHEN slot % 5 = 1 THEN trades_count + 1 ELSE trades_count END AS trades_count, CASE WHEN slot % 5 = 2 THEN time_close + 1 ELSE time_close END AS time_close,
    CASE WHEN slot % 5 = 3 THEN 'archive' ELSE source_transport END AS source_transport) FROM (SELECT *, time // 3600000 AS slot FROM wide) WHERE slot % 7 <> 0)"""


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars with all their fields, and what a store holds of them: differing in a count, in a close time or only in transport."""
    wide = tables.bars_1h(spark, sf_dir).withColumn("source_transport", F.lit("rest"))
    slot = F.floor(F.col("time") / HOUR)
    other = wide.where(slot % 7 != 0).withColumns({
        "trades_count": F.col("trades_count") + F.when(slot % 5 == 1, 1).otherwise(0), "time_close": F.col("time_close") + F.when(slot % 5 == 2, 1).otherwise(0),
        "source_transport": F.when(slot % 5 == 3, "archive").otherwise(F.col("source_transport")),
    })
    return wide, other


@query(f"""WITH {BARS}, {_WIDE} SELECT a.symbol, a.time, CASE WHEN b.symbol IS NULL THEN 'new' WHEN (a.trades_count, a.time_close) = (b.trades_count, b.time_close) THEN 'duplicate' ELSE 'conflict' END AS outcome
       FROM wide a LEFT JOIN other b ON a.symbol = b.symbol AND a.time = b.time""")
def candle_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles are compared in all fields of their identity; where they came from isn't one."""
    return merge.classify_bulk(*_wide(spark, sf_dir)).select("symbol", "time", "outcome")


@query(f"""WITH {BARS}, {_WIDE} SELECT symbol, time, CAST(2 AS BIGINT) AS candles FROM other WHERE slot % 5 IN (1, 2)""")
def bulk_write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that one batch gives with different candles."""
    wide, other = _wide(spark, sf_dir)
    return merge.batch_conflicts(wide.unionByName(other))


@query(f"""WITH {BARS}, {_WIDE}, both_ AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.symbol IS NOT NULL AS l, b.symbol IS NOT NULL AS r, (a.trades_count, a.time_close) = (b.trades_count, b.time_close) AS same
         FROM wide a FULL JOIN other b ON a.symbol = b.symbol AND a.time = b.time)
       SELECT symbol, count(*) FILTER (WHERE l) AS checked, count(*) FILTER (WHERE l AND NOT r) AS missing, count(*) FILTER (WHERE l AND r AND NOT same) AS mismatch, count(*) FILTER (WHERE NOT l) AS extra,
       count(*) FILTER (WHERE NOT l OR NOT r OR NOT same) AS changed FROM both_ GROUP BY symbol""")
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.audit_counts(*_wide(spark, sf_dir), strict=True)


def _stored(spark: SparkSession, sf_dir: str) -> BarStore:
    """A store written in three commits: the bars before the cutoff, later ones, and a merge that touches one series."""
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1h")}
    bars = tables.bars_1h(spark, sf_dir).withColumns(names)
    store = BarStore(spark, f"{_scratch(spark)}/store")
    store.write_closed(bars.where(F.col("time") < CUTOFF))
    store.append_newer(bars.where(F.col("time") >= CUTOFF))
    store.merge(bars.where("symbol = 'CLICK'").withColumn("close", F.col("high")))
    return store


_STORED = f"""WITH {BARS}, now AS (SELECT * REPLACE (CASE WHEN symbol = 'CLICK' THEN high ELSE close END AS close) FROM bars)"""


@query(_STORED + """ SELECT 'binance' AS exchange, symbol, count(*) AS rows_count, min(time) AS start_time, max(time) AS end_time, arg_max(close, time) AS last_close, CAST(0 AS BIGINT) AS downloaded_at,
       CASE WHEN symbol = 'CLICK' THEN 1 ELSE 2 END AS commits FROM now GROUP BY symbol""")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored manifest, a row per series, kept up by each commit."""
    found = _stored(spark, sf_dir).manifest()
    return found.select("exchange", "symbol", "rows_count", "start_time", "end_time", "last_close", "downloaded_at", F.size("parts").alias("commits"))


@query(_STORED + " SELECT symbol, time, open, high, low, close, volume, time_close, trades_count FROM now")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).read_all().drop("exchange", "market", "timeframe", "source_kind")


@query(_STORED + f" SELECT symbol, time, close FROM now WHERE symbol = 'CLICK' AND time >= {CUTOFF - 48 * HOUR} AND time < {CUTOFF + 24 * HOUR}")
def store_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of one series and range, from its own folders."""
    asked = BarQuery(Instrument("binance", "spot", "CLICK"), timeframe.Timeframe.parse("1h"), CUTOFF - 48 * HOUR, CUTOFF + 24 * HOUR)
    return _stored(spark, sf_dir).read(asked).select("symbol", "time", "close")


@query(f"""WITH {PAIR}, kept AS (SELECT * FROM source WHERE (time // 3600000) % 17 <> 0), lim AS (SELECT symbol, min(time) AS a, max(time) AS b FROM kept GROUP BY symbol)
       SELECT * FROM kept UNION ALL SELECT s.* FROM source s JOIN lim ON s.symbol = lim.symbol WHERE (s.time // 3600000) % 17 = 0 AND s.time > lim.a AND s.time < lim.b""")
def gap_fill_from_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, _ = _pair(spark, sf_dir)
    store = archive.where(F.floor(F.col("time") / HOUR) % 17 != 0)
    return merge.fill_gaps(store, archive, coverage.missing_slots(store, coverage.series_ranges(store, "1h"), "1h"))


@query(f"""WITH {BARS}, days AS (SELECT symbol, (time // 86400000) * 86400000 AS chart_time, (time // 86400000) * 86400000 + 86399999 AS chart_close FROM bars GROUP BY ALL)
       SELECT d.symbol, d.chart_time, count(*) AS bars, max(b.high) AS high FROM days d JOIN bars b ON b.symbol = d.symbol AND b.time BETWEEN d.chart_time AND d.chart_close GROUP BY d.symbol, d.chart_time""")
def intrabar_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    found = merge.intrabar(resample.resample(bars, "1D"), bars, "1D")
    return found.groupBy("symbol", "chart_time").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"))


@query(f"WITH {BARS} SELECT symbol, max(time) AS time, arg_max(close, time) AS close FROM bars GROUP BY symbol")
def latest_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.bars_1h(spark, sf_dir).select("symbol", "time", "close").withColumn("seq", F.col("time"))
    return merge.keep_last(rows, ["symbol"], "seq").drop("seq")


@query(f"WITH {BARS} SELECT symbol, count(*) AS rows_count, min(time) AS start_time, max(time) AS end_time, arg_max(close, time) AS last_close FROM bars GROUP BY symbol")
def series_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.manifest(tables.bars_1h(spark, sf_dir))


# --- revisions and hashes ----------------------------------------------------------------------------------------------

CHAINS = """ranked AS (SELECT l_orderkey * 60000 AS time, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS revision,
    l_returnflag, CAST(l_extendedprice AS DOUBLE) AS close FROM lineitem),
  rev AS (SELECT *, CASE WHEN revision = 0 THEN 'ORIGINAL' WHEN l_returnflag = 'R' THEN 'REVOKED' ELSE 'CORRECTED' END AS state FROM ranked),
  chain AS (SELECT time, count(*) AS revisions, max(revision) AS last, arg_max(state, revision) AS last_state, coalesce(min(revision) FILTER (WHERE state = 'REVOKED'), 999) AS revoked_at FROM rev GROUP BY time)"""


@query(f"WITH {CHAINS} SELECT c.time, r.revision, r.close FROM chain c JOIN rev r ON r.time = c.time AND r.revision = c.last WHERE c.last <= c.revoked_at AND c.last_state <> 'REVOKED'")
def revision_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.select_revisions(tables.revisions(spark, sf_dir)).select("time", "revision", "close")


@query(f"""WITH {CHAINS} SELECT time, CASE WHEN last > revoked_at THEN 'after_revocation' END AS reason, CASE WHEN last <= revoked_at AND last_state <> 'REVOKED' THEN last END AS selected_revision,
       last <= revoked_at AND last_state = 'REVOKED' AS revoked, revisions, CAST(0 AS BIGINT) AS duplicates FROM chain""")
def revision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.chains(tables.revisions(spark, sf_dir)).drop("series")


@query(f"WITH {CHAINS} SELECT time, 'after_revocation' AS reason FROM chain WHERE last > revoked_at")
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.chains(tables.revisions(spark, sf_dir)).where("reason IS NOT NULL").select("time", "reason")


RULED = """items AS (SELECT l_orderkey AS o, l_orderkey % 8 AS k, l_returnflag, CAST(l_extendedprice AS DOUBLE) AS close,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem),
  uniq AS (SELECT o * 60000 AS time, n, k, CASE WHEN k = 2 AND n > 1 THEN 1 WHEN k = 3 THEN 10 - n ELSE n END AS revision, close,
    CASE WHEN n = 0 THEN CASE WHEN k = 4 THEN 'CORRECTED' ELSE 'ORIGINAL' END WHEN l_returnflag = 'R' THEN 'REVOKED' ELSE 'CORRECTED' END AS state,
    CASE WHEN k = 1 AND n = 1 THEN 'bybit' ELSE 'binance' END AS provider, k = 5 AND n = 1 AS unbound FROM items),
  flagged AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY time, revision ORDER BY n) > 1 THEN 'repeated_revision'
      WHEN revision <= max(revision) OVER (PARTITION BY time ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'falling_revision'
      WHEN lag(state) OVER (PARTITION BY time ORDER BY n) = 'REVOKED' THEN 'after_revocation' WHEN n = 0 AND state <> 'ORIGINAL' THEN 'no_original' WHEN unbound THEN 'broken_lineage' END AS broken FROM uniq),
  ended AS (SELECT time, CASE WHEN min(provider) <> max(provider) THEN 'several_providers' ELSE arg_min(broken, n) FILTER (WHERE broken IS NOT NULL) END AS reason, arg_max(revision, n) AS last_revision,
      arg_max(state, n) AS last_state, arg_max(close, n) AS last_close, count(*) AS revisions, CASE WHEN any_value(k) = 6 THEN count(*) ELSE 0 END AS duplicates FROM flagged GROUP BY time)"""


@query(f"""WITH {RULED} SELECT time, reason, CASE WHEN reason IS NULL AND last_state <> 'REVOKED' THEN last_revision END AS selected_revision, reason IS NULL AND last_state = 'REVOKED' AS revoked,
       revisions, CAST(duplicates AS BIGINT) AS duplicates FROM ended""")
def revision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with lineage and bars that arrive twice, in which every rule is broken somewhere."""
    return revisions.chains(tables.ruled_revisions(spark, sf_dir)).drop("series")


@query(f"WITH {RULED} SELECT time, last_revision AS revision, last_close AS close FROM ended WHERE reason IS NULL AND last_state <> 'REVOKED'")
def revision_rules_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.select_revisions(tables.ruled_revisions(spark, sf_dir)).select("time", "revision", "close")


@query(f"""WITH {BARS}, long AS (SELECT symbol, time, time_close + CASE WHEN (time // 3600000) % 5 = 0 THEN 1800000 ELSE 0 END AS time_close FROM bars), s AS (SELECT *, lag(time_close) OVER (PARTITION BY symbol ORDER BY time) AS previous_close FROM long)
       SELECT symbol, time, previous_close FROM s WHERE time <= previous_close""")
def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = F.when(F.floor(F.col("time") / HOUR) % 5 == 0, HOUR // 2).otherwise(0)
    bars = tables.bars_1h(spark, sf_dir).withColumn("time_close", F.col("time_close") + longer)
    return revisions.overlaps(bars, keys=("symbol",)).select("symbol", "time", "previous_close")


_HASH = "'sha256:' || sha256(concat_ws(chr(31), '{domain}', {fields}))"
_ROW = ", ".join(f"'=' || CAST({c} AS DECIMAL(18,2))" for c in ("open", "high", "low", "close"))


@query(f"WITH {BARS} SELECT symbol, time, {_HASH.format(domain='bar', fields=f'''coalesce('=' || symbol, '~'), '=' || time, {_ROW}, '=' || trades_count''')} AS content_hash FROM bars")
def bar_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = [F.col(c).cast("decimal(18,2)") for c in ("open", "high", "low", "close")]
    hashed = hashing.digest([F.col("symbol"), F.col("time"), *prices, F.col("trades_count")], "bar")
    return tables.bars_1h(spark, sf_dir).select("symbol", "time", hashed.alias("content_hash"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, time, time // 86400000 AS day, {_HASH.format(domain='row', fields="'=' || time, '=' || trades_count")} AS d FROM bars),
       days AS (SELECT symbol, day, 'sha256:' || sha256(string_agg(d, chr(10) ORDER BY time)) AS d, count(*) AS n FROM r GROUP BY symbol, day)
       SELECT symbol, 'sha256:' || sha256(string_agg(d, chr(10) ORDER BY day)) AS checksum, CAST(sum(n) AS BIGINT) AS rows_count FROM days GROUP BY symbol""")
def series_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.series_checksum(tables.bars_1h(spark, sf_dir), ["time", "trades_count"])


@query(f"""WITH RECURSIVE {BARS}, days AS (SELECT symbol, time // 86400000 AS day, list(sha256(time || '|' || trades_count) ORDER BY time) AS x FROM bars GROUP BY symbol, time // 86400000),
       ranked AS (SELECT symbol, day, list_reduce(list_prepend('', x), lambda a, b: sha256(a || chr(31) || b)) AS link, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM days),
       walk AS (SELECT symbol, day, n, sha256(chr(31) || link) AS chain FROM ranked WHERE n = 1
                UNION ALL SELECT r.symbol, r.day, r.n, sha256(w.chain || chr(31) || r.link) FROM walk w JOIN ranked r ON r.symbol = w.symbol AND r.n = w.n + 1)
       SELECT symbol, day, chain FROM walk""")
def tail_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars are chained within their day, days within the series: each day's link covers all that came before it."""
    row = F.sha2(F.concat_ws("|", "time", "trades_count"), 256).alias("d")
    days = tables.bars_1h(spark, sf_dir).groupBy("symbol", F.floor(F.col("time") / 86_400_000).alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", row))).alias("x"))
    return revisions.chained_days(days.select("symbol", "day", hashing.chained(F.transform("x", lambda y: y.d)).alias("link")))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', '') END AS price FROM part""")
def decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("00"), F.col("p_retailprice").cast("decimal(18,4)").cast("string"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", hashing.decimal_text(text).alias("price"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1h")}
    return revisions.canonical_bars(tables.bars_1h(spark, sf_dir).withColumns(names), SERVER, provider_revision="r1")


_ENDS = "(SELECT min(time) FROM bars) AS a, (SELECT max(time) + 3600000 FROM bars) AS b"


@query(f"""WITH {BARS}, span AS (SELECT {_ENDS}), s AS (SELECT *, lag(time_close) OVER (PARTITION BY symbol ORDER BY time) AS before FROM bars WHERE time_close <= {SERVER})
       SELECT 'binance/spot/' || symbol || '/1h' AS series, min(time) AS covered_start, max(time_close) + 1 AS covered_end, count(*) AS bar_count,
       count(*) FILTER (WHERE coalesce(time > before + 1, time > a)) + CASE WHEN max(time_close) + 1 < any_value(b) THEN 1 ELSE 0 END AS gap_count FROM s, span GROUP BY symbol""")
def snapshot_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed snapshots of every series over one range, written, and their envelopes read back."""
    bars = _canonical(spark, sf_dir)
    span = bars.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    store = SnapshotStore(spark, f"{_scratch(spark)}/snapshots")
    store.write(bars, start=span["a"], end=span["b"] + HOUR)
    return store.envelopes().select("series", "covered_start", "covered_end", "bar_count", "gap_count")


@query(f"WITH {BARS} SELECT 'binance/spot/' || symbol || '/1h' AS series, time, open, high, low, close, volume FROM bars WHERE symbol = 'CLICK' AND time_close <= {SERVER}")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written and read back by its id, hashes and envelope made anew on the way."""
    bars = _canonical(spark, sf_dir).where("symbol = 'CLICK'")
    span = bars.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    store = SnapshotStore(spark, f"{_scratch(spark)}/snapshots")
    made = store.write(bars, start=span["a"], end=span["b"] + HOUR).first()
    return store.read(made["snapshot_id"]).select("series", "time", "open", "high", "low", "close", "volume")


@query(f"""WITH {BARS} SELECT symbol, time, time_close, 'binance/spot/' || symbol AS instrument_id, CASE WHEN time_close <= {SERVER} THEN 'FINAL' ELSE 'OPEN' END AS finality, 'ORIGINAL' AS revision_state,
       CAST(0 AS BIGINT) AS revision, true AS verified FROM bars""")
def canonical_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as canonical bars, whose hashes agree when they are computed again."""
    good = revisions.verified(_canonical(spark, sf_dir))
    return good.select("symbol", "time", "time_close", "instrument_id", "finality", "revision_state", "revision", (F.col("content_hash") == revisions.content_hash()).alias("verified"))


_SHA = "'sha256:' || sha256"
REVISED = f"""ranked AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)),
  revised AS (SELECT 'binance/spot/S' || l_orderkey % 4 AS id, l_orderkey AS k, l_orderkey * 60000 AS time, n, CASE WHEN n = 0 THEN 'ORIGINAL' WHEN n = c - 1 AND l_returnflag = 'R' THEN 'REVOKED' ELSE 'CORRECTED' END AS state,
    l_extendedprice AS price, l_quantity AS volume, n = c - 1 AS last FROM ranked),
  bodies AS (SELECT *, concat_ws(chr(31), 'canonical-bar/2', '=' || id, '=1m', '=' || time, '=' || (time + 59999), '=' || price, '=' || price, '=' || price, '=' || price, '=' || volume, '=FINAL', '=' || state, '=' || n, '=binance', '=r1') AS body FROM revised),
  links AS (SELECT id, k, time, n, state, last, {_SHA}(body || chr(31) || '~') AS own FROM bodies WHERE n = 0
    UNION ALL SELECT b.id, b.k, b.time, b.n, b.state, b.last, {_SHA}(b.body || chr(31) || '=' || l.own) FROM links l JOIN bodies b ON b.k = l.k AND b.n = l.n + 1),
  chosen AS (SELECT id || '/1m' AS series, time, own, lag(time) OVER (PARTITION BY id ORDER BY time) AS before FROM links WHERE last AND state <> 'REVOKED'),
  days AS (SELECT series, time // 86400000 AS day, {_SHA}(string_agg({_SHA}('row' || chr(31) || '=' || own), chr(10) ORDER BY time)) AS d FROM chosen GROUP BY ALL),
  sums AS (SELECT series, {_SHA}(string_agg(d, chr(10) ORDER BY day)) AS checksum FROM days GROUP BY series),
  span AS (SELECT (max(l_orderkey) + 1) * 60000 AS b FROM lineitem),
  counts AS (SELECT series, count(*) AS bar_count, count(*) FILTER (WHERE coalesce(time > before + 60000, time > 0)) + CASE WHEN max(time) + 60000 < any_value(b) THEN 1 ELSE 0 END AS gap_count FROM chosen, span GROUP BY series),
  sealed AS (SELECT series, bar_count, gap_count, {_SHA}(concat_ws(chr(31), 'series', '=' || series, '=0', '=' || b, '=r1', '=' || checksum)) AS series_hash FROM counts JOIN sums USING (series), span)"""


@query(f"WITH RECURSIVE {REVISED} SELECT *, {_SHA}('snapshot' || chr(31) || '=' || series_hash) AS snapshot_id FROM sealed")
def revision_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions of a bar per order, bound to chains, resolved, sealed, stored, and their envelopes read back."""
    from pyspark.sql import Window

    n, key = F.col("n"), F.col("l_orderkey")
    instrument = F.concat(F.lit("binance/spot/S"), key % 4)
    # Series and time stand for the order's key, so that numbering deals the rows as chains need them: one shuffle does.
    keyed = tables.table(spark, sf_dir, "lineitem").withColumns({"instrument_id": instrument, "series": F.concat(instrument, F.lit("/1m")), "time": key * 60_000})
    own = Window.partitionBy("series", "time")
    ranked = keyed.withColumns({
        "n": F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")).cast("long") - 1, "c": F.count(F.lit(1)).over(own),
    })
    state = F.when(n == 0, "ORIGINAL").when((n == F.col("c") - 1) & (F.col("l_returnflag") == "R"), "REVOKED").otherwise("CORRECTED")
    rows = ranked.select(
        "series", "instrument_id", F.lit("1m").alias("timeframe"), "time", (F.col("time") + 59_999).alias("time_close"),
        *[F.col("l_extendedprice").alias(p) for p in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"), F.lit("FINAL").alias("finality"), state.alias("revision_state"),
        n.alias("revision"), F.lit("binance").alias("provider"), F.lit("r1").alias("provider_revision"),
    )
    end = (tables.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("k")).first()["k"] + 1) * 60_000
    store = SnapshotStore(spark, f"{_scratch(spark)}/snapshots")
    store.write_revisions(rows, start=0, end=end)
    return store.envelopes().select("series", "bar_count", "gap_count", "series_hash", "snapshot_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1h"), "is_closed": F.col("time_close") <= SERVER, "provider_revision": F.lit("r1")}
    texts = {f"{n}_text": F.concat(F.lit("0"), F.col(n).cast("decimal(18,4)").cast("string")) for n in ("open", "high", "low", "close", "volume")}
    return tables.bars_1h(spark, sf_dir).withColumns(names | texts)


@query(f"""WITH {BARS} SELECT 'binance' AS exchange, 'spot' AS market, symbol, '1h' AS timeframe, time, time_close, open, high, low, close, volume, time_close <= {SERVER} AS is_closed,
       'canonical' AS source_transport, 'binance' AS provider, 'r1' AS provider_revision, 'ORIGINAL' AS revision_state, CAST(0 AS BIGINT) AS revision FROM bars""")
def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as canonical rows with exact texts, and as bars again."""
    back = projections.from_canonical(projections.canonical_rows(_texts(spark, sf_dir), provider="binance"))
    return back.drop("open_text", "high_text", "low_text", "close_text", "volume_text")


@query(f"""WITH {BARS} SELECT symbol, time, time_close, volume, time_close <= {SERVER} AS is_closed, {_SHA}(concat_ws(chr(31), 'contract-bar', '=binance/spot/' || symbol, '=1h', '=' || time, '=' || time_close, '=' || open, '=' || high,
       '=' || low, '=' || close, '=' || volume, '=' || (time_close <= {SERVER}))) AS provider_revision FROM bars""")
def contract_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as contract bars, and these as bars to store, with the hash of what the contract says."""
    made = projections.market_bars(projections.contract_bars(_texts(spark, sf_dir).drop("time_close")))
    return made.select("symbol", "time", "time_close", "volume", "is_closed", "provider_revision")


@query(f"""WITH {BARS} SELECT symbol, time, CASE WHEN symbol <> 'CLICK' THEN 'symbol' ELSE 'timeframe' END AS differs FROM bars WHERE symbol <> 'CLICK' OR (time // 3600000) % 11 = 0""")
def identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that aren't of a query's series: of another symbol, or of another timeframe however it is spelled."""
    name = F.when(F.floor(F.col("time") / HOUR) % 11 == 0, "4h").when(F.floor(F.col("time") / HOUR) % 11 == 1, "01h").otherwise("1H")
    wanted = BarQuery(Instrument("binance", "spot", "click"), timeframe.Timeframe.parse("1h"), 0, CUTOFF)
    bars = _texts(spark, sf_dir).withColumn("timeframe", name)
    return projections.strangers(bars, wanted).select("symbol", "time", "differs")


# --- symbols -----------------------------------------------------------------------------------------------------------

SYMBOLS = """symbols AS (SELECT p_partkey, p_name AS name, upper(replace(p_brand, '#', '')) AS base, list_extract(['USDT','USDC','FDUSD','BUSD','TUSD','USDP','DAI','USD','EUR'], CAST(p_partkey % 9 AS INTEGER) + 1) AS quote, p_size % 5 = 0 AS perp FROM part)"""


@query(f"""WITH {SYMBOLS} SELECT p_partkey, 'binance' AS exchange, CASE WHEN perp THEN 'usdm' ELSE 'spot' END AS market, base, quote, 'BINANCE:' || base || quote || CASE WHEN perp THEN '.P' ELSE '' END AS tv_symbol,
       base || quote AS exchange_symbol, perp AS is_perpetual FROM symbols""")
def symbol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.normalise_symbols(tables.symbols(spark, sf_dir).drop("name"), "binance").drop("symbol", "error")


@query(f"WITH {SYMBOLS} SELECT p_partkey, base, quote FROM symbols WHERE quote IN ('USDT', 'USDC')")
def stable_quote_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.search_symbols(tables.symbols(spark, sf_dir), quotes=("USDT", "USDC"), limit=None).select("p_partkey", "base", "quote")


@query(f"WITH {SYMBOLS} SELECT p_partkey, base || quote || CASE WHEN perp THEN '.P' ELSE '' END AS symbol, quote FROM symbols WHERE contains(base || quote, 'BRAND1') ORDER BY p_partkey LIMIT 50")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.search_symbols(tables.symbols(spark, sf_dir), "brand1", order="p_partkey").select("p_partkey", "symbol", "quote")


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(upper(trim(p_name || ' ' || p_type)), '[^A-Z0-9._-]+', '_', 'g'), '._'), ''), 'UNKNOWN') AS part FROM part")
def safe_path_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", identity.safe_path_part(F.concat_ws(" ", "p_name", "p_type")).alias("part"))


@query(f"WITH {SYMBOLS} SELECT p_partkey, 'binance/spot/' || base || quote AS id, 'binance' AS exchange, 'spot' AS market, base || quote AS symbol FROM symbols")
def instrument_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.lower("symbol"), r"\.p$", "")
    rows = tables.symbols(spark, sf_dir).select("p_partkey", identity.instrument_id(F.lit(" Binance"), F.lit("SPOT "), name).alias("id"))
    return rows.withColumn("x", identity.parsed_instrument(F.col("id"))).select("p_partkey", "id", "x.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'usdt_futures' WHEN 1 THEN 'spot' WHEN 2 THEN 'coin_futures' END AS market_type FROM part""")
def market_type_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candela.catalog import market_type

    alias = F.element_at(F.array(*map(F.lit, ("Linear", "cash ", "inverse-swap", "none"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", market_type(alias).alias("market_type"))


@query("""SELECT * FROM (VALUES ('binance', 'Binance', 1, 5), ('bybit', 'Bybit', 2, 4), ('okx', 'OKX', 3, 6), ('coinbase', 'Coinbase Exchange', 4, 1), ('kraken', 'Kraken', 5, 5), ('kucoin', 'KuCoin', 6, 4),
       ('bitget', 'Bitget', 7, 4), ('gateio', 'Gate.io', 8, 5), ('htx', 'HTX / Huobi', 9, 4), ('mexc', 'MEXC', 10, 3)) AS t(exchange, name, rank, market_types)""")
def exchange_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candela.catalog import exchanges

    return exchanges(spark).withColumn("market_types", F.size("market_types"))


@query("""SELECT p_partkey, list_extract(['binance','coinbase','gateio','htx','mexc','bybit','kraken'], CAST(p_partkey % 7 AS INTEGER) + 1) AS exchange FROM part""")
def exchange_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candela.catalog import exchange_id

    names = ("BinanceUSDM", " coinbase_exchange", "Gate_IO", "huobi ", "mexc-global", "bybit_v5", "Kraken")
    return tables.table(spark, sf_dir, "part").select("p_partkey", exchange_id(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7).cast("int"))).alias("exchange"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of a base and a quote with a status, some of them barred from trading, some without."""
    k = F.col("p_partkey")
    status = F.get(F.array(*map(F.lit, ("online", "live", "tradable", "Halt", "cancel_only", "settled", ""))), (k % 7).cast("int"))
    base = F.when(k % 10 == 0, "XBT").otherwise(F.concat(F.lit("P"), k))
    return tables.table(spark, sf_dir, "part").select(k, base.alias("base"), F.when(k % 3 == 0, "USDC").otherwise("USDT").alias("quote"), status.alias("status"), F.floor(k / 100).alias("page"))


_CATALOGUE = """WITH rows AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'XBT' ELSE 'P' || p_partkey END AS raw, CASE WHEN p_partkey % 3 = 0 THEN 'USDC' ELSE 'USDT' END AS quote FROM part),
  found AS (SELECT *, CASE WHEN raw = 'XBT' THEN 'BTC' ELSE raw END AS base FROM rows)"""


def _catalogue_sql(exchange: str, symbol: str, rule: str, market: str = "spot") -> str:
    return f"{_CATALOGUE} SELECT '{exchange}' AS exchange, '{market}' AS market, {symbol} AS symbol, base, quote FROM found WHERE {rule}"


def _pages(rows: DataFrame, item: F.Column, wrap: Callable[[F.Column], F.Column]) -> DataFrame:
    return rows.groupBy("page").agg(F.collect_list(item).alias("items")).select(wrap(F.col("items")).alias("payload"))


@query(_catalogue_sql("kucoin", "raw || '-' || quote", "k % 7 NOT IN (3, 4, 5) AND k % 11 <> 0"))
def catalogue_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of objects below one key, with a status and a flag."""
    rows = _catalogue(spark, sf_dir)
    item = F.struct(F.concat_ws("-", "base", "quote").alias("symbol"), F.col("base").alias("baseCurrency"), F.col("quote").alias("quoteCurrency"), "status", (F.col("p_partkey") % 11 != 0).alias("enableTrading"))
    return symbols.decode_catalogue(_pages(rows, item, lambda x: F.to_json(F.struct(x.alias("data")))), "kucoin")


@query(_catalogue_sql("kraken", "raw || quote", "k % 7 NOT IN (3, 4, 5)"))
def catalogue_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of objects by name, base and quote told by a second name."""
    rows = _catalogue(spark, sf_dir)
    item = F.struct(F.col("p_partkey").cast("string").alias("key"), F.struct(F.concat("base", "quote").alias("altname"), F.concat_ws("/", "base", "quote").alias("wsname"), F.lit("X").alias("base"), F.lit("Z").alias("quote"), "status").alias("value"))
    return symbols.decode_catalogue(_pages(rows, item, lambda x: F.to_json(F.struct(F.map_from_entries(x).alias("result")))), "kraken")


@query(_catalogue_sql("gateio", "raw || '_' || quote", "k % 7 IN (2, 6)"))
def catalogue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue that is a list at the top, of symbols with one status that allows trading."""
    item = F.struct(F.concat_ws("_", "base", "quote").alias("id"), "base", "quote", F.col("status").alias("trade_status"))
    return symbols.decode_catalogue(_pages(_catalogue(spark, sf_dir), item, F.to_json), "gateio")


@query(_catalogue_sql("mexc", "raw || '_' || quote", "k % 11 <> 0 AND k % 5 <> 0", "linear"))
def catalogue_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of one kind, base and quote told by the symbol's parts."""
    k = F.col("p_partkey")
    item = F.struct(F.concat_ws("_", "base", "quote").alias("symbol"), F.when(k % 5 == 0, "BTC").otherwise("USDT").alias("settleCoin"), F.lit(0).alias("state"), (k % 11 != 0).alias("apiAllowed"))
    return symbols.decode_catalogue(_pages(_catalogue(spark, sf_dir), item, lambda x: F.to_json(F.struct(x.alias("data")))), "mexc", market="linear")


@query(f"{_CATALOGUE} SELECT k AS p_partkey FROM found WHERE k % 7 NOT IN (3, 4, 5)")
def tradable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.tradable(_catalogue(spark, sf_dir)).select("p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'P' || p_partkey END AS base, CASE WHEN p_partkey % 4 = 3 THEN '-USDT' ELSE 'P' || p_partkey || '-USDT' END AS okx FROM part""")
def query_base_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base asset that a search text names, and the symbol to ask for."""
    name = F.concat(F.lit("p"), F.col("p_partkey"))
    text = F.get(F.array(F.concat(name, F.lit("/usdt ")), F.concat(name, F.lit("usdc")), F.concat(F.lit(" "), name, F.lit("_x")), F.lit(" ")), (F.col("p_partkey") % 4).cast("int"))
    base = symbols.query_base(text)
    return tables.table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), symbols.candidate_symbol("okx", base, F.lit("USDT")).alias("okx"))


@query(f"WITH {TRADES} SELECT trade_id, CASE WHEN time % 1000 = 0 THEN strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS at FROM trades")
def iso_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trades(spark, sf_dir).select("trade_id", timeframe.iso_text(F.col("time")).alias("at"))


# --- payloads ----------------------------------------------------------------------------------------------------------


def _text(name: str) -> F.Column:
    return F.col(name).cast("decimal(18,2)").cast("string")


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume, time_close, trades_count FROM bars")
def kline_json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as exchange rows, a payload per series and day, and decoded again."""
    fields = [F.col("time").cast("string"), *map(_text, ("open", "high", "low", "close", "volume")), F.col("time_close").cast("string"), F.lit("0"), F.col("trades_count").cast("string"), F.lit("0"), F.lit("0"), F.lit("0")]
    rows = tables.bars_1h(spark, sf_dir).select("symbol", F.floor(F.col("time") / 86_400_000).alias("day"), F.array(*fields).alias("row"))
    payloads = rows.groupBy("symbol", "day").agg(F.to_json(F.collect_list("row")).alias("payload"))
    return decode.decode_binance(payloads).select("symbol", "time", "open", "high", "low", "close", "volume", "time_close", "trades_count")


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume, time_close FROM bars")
def kline_permuted_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a layout with other places and seconds."""
    fields = [(F.col("time") / 1000).cast("long").cast("string"), *map(_text, ("low", "high", "open", "close", "volume"))]
    rows = tables.bars_1h(spark, sf_dir).select("symbol", F.floor(F.col("time") / 86_400_000).alias("day"), F.array(*fields).alias("row"))
    payloads = rows.groupBy("symbol", "day").agg(F.to_json(F.collect_list("row")).alias("payload"))
    return decode.decode_klines(payloads, "coinbase", "1h").select("symbol", "time", "open", "high", "low", "close", "volume", "time_close")


#: Where time, open, high, low, close and volume stand in rows of so many fields, and milliseconds in a unit of time.
_LAYOUTS = {
    "okx": (6, (0, 1, 2, 3, 4, 5), 1), "bitget": (6, (0, 1, 2, 3, 4, 5), 1), "bybit": (6, (0, 1, 2, 3, 4, 5), 1), "mexc": (6, (0, 1, 2, 3, 4, 5), 1), "coinbase": (6, (0, 3, 2, 1, 4, 5), 1000),
    "kraken": (7, (0, 1, 2, 3, 4, 6), 1000), "kucoin": (6, (0, 1, 3, 4, 2, 5), 1000), "gateio": (6, (0, 5, 3, 4, 2, 1), 1000),
}


@query(f"WITH {BARS} SELECT x.exchange, symbol, time, open, high, low, close, volume FROM bars, (VALUES " + ", ".join(f"('{x}')" for x in _LAYOUTS) + ") AS x(exchange)")
def kline_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per series, day and exchange in each exchange's layout, its rows below the key that it uses, decoded again."""
    bars = tables.bars_1h(spark, sf_dir)
    found = []
    for exchange, (width, places, unit) in _LAYOUTS.items():
        values = [(F.col("time") / unit).cast("long").cast("string"), *map(_text, ("open", "high", "low", "close", "volume"))]
        row = F.array(*[values[places.index(k)] if k in places else F.lit("x") for k in range(width)])
        rows = F.collect_list(row).alias("data")
        pages = bars.groupBy("symbol", F.floor(F.col("time") / 86_400_000).alias("day")).agg(rows)
        data = F.col("data")
        body = {
            "okx": F.struct(data), "bitget": F.struct(data), "kucoin": F.struct(data), "bybit": F.struct(F.struct(data.alias("list")).alias("result")),
            "kraken": F.struct(F.struct(F.lit(7).alias("last"), data.alias("XBTUSD")).alias("result")),
        }.get(exchange, data)
        decoded = decode.decode_klines(pages.select("symbol", F.to_json(body).alias("payload")), exchange, "1h")
        found.append(decoded.select(F.lit(exchange).alias("exchange"), "symbol", "time", "open", "high", "low", "close", "volume"))
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {BARS} SELECT x.exchange, symbol, time, open, high, low, close, volume FROM bars, (VALUES ('gateio'), ('htx'), ('kraken')) AS x(exchange)")
def kline_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract candles that are objects, with names and units of their own."""
    layouts = {"gateio": ("t", "o", "h", "l", "c", "v", 1000), "htx": ("id", "open", "high", "low", "close", "amount", 1000), "kraken": ("time", "open", "high", "low", "close", "volume", 1)}
    found = []
    for exchange, (*names, unit) in layouts.items():
        values = [(F.col("time") / unit).cast("long"), *map(_text, ("open", "high", "low", "close", "volume"))]
        row = F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
        pages = tables.bars_1h(spark, sf_dir).groupBy("symbol", F.floor(F.col("time") / 86_400_000).alias("day")).agg(F.collect_list(row).alias("candles"))
        body = {"kraken": F.struct("candles"), "htx": F.struct(F.col("candles").alias("data"))}.get(exchange, F.col("candles"))
        decoded = decode.decode_klines(pages.select("symbol", F.to_json(body).alias("payload")), exchange, "1h", derivative=True)
        found.append(decoded.select(F.lit(exchange).alias("exchange"), "symbol", "time", "open", "high", "low", "close", "volume"))
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume FROM bars")
def columnar_kline_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of one array per field, zipped into rows."""
    names = ("open", "high", "low", "close", "volume")
    rows = tables.bars_1h(spark, sf_dir).groupBy("symbol", F.floor(F.col("time") / 86_400_000).alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", *names))).alias("x"))
    arrays = [F.transform("x", lambda y: (y.time / 1000).cast("long")).alias("time"), *[F.col("x").getField(n).alias("vol" if n == "volume" else n) for n in names]]
    payloads = rows.select("symbol", F.to_json(F.struct(F.struct(*arrays).alias("data"))).alias("payload"))
    return decode.decode_columnar(payloads)


# --- streams -----------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; a local master may do with a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/market-{uuid.uuid4().hex}"


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume FROM bars")
def stream_ohlcv_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the trades as a file stream; a last row far ahead moves the watermark past every bar."""
    root = _scratch(spark)
    rows = tables.trades(spark, sf_dir).withColumn("at", F.timestamp_micros("micros"))
    rows.write.parquet(f"{root}/in")
    later = spark.range(1).select(F.lit(-1).cast("long").alias("trade_id"), F.lit(CUTOFF * 2).alias("time"), F.lit(CUTOFF * 2000).alias("micros"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("quantity"), F.lit(False).alias("buyer_maker"), F.lit("").alias("symbol"))
    later.withColumn("at", F.timestamp_micros("micros")).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in")
    bars = klines.stream_bars(stream, "1h", delay="400 days")
    bars.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{root}/out").where("symbol != ''")


UPDATES = BARS + """, updates AS (
  SELECT symbol, time AS open_time, time + 60000 AS event_time, open, open AS close, 0.0 AS volume, false AS is_closed FROM bars
  UNION ALL SELECT symbol, time, time + 3600000, open, close, volume, true FROM bars
  UNION ALL SELECT symbol, time, time + 3700000, open, close, volume, (time // 3600000) % 2 = 0 FROM bars WHERE (time // 3600000) % 3 = 0
  UNION ALL SELECT symbol, time, time + 3800000, open, close + 1, volume, true FROM bars WHERE (time // 3600000) % 5 = 0)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_1h(spark, sf_dir)
    slot = F.floor(F.col("time") / HOUR)
    lit = lambda x: F.lit(x)

    def update(rows: DataFrame, after: int, closed: F.Column, close: F.Column, volume: F.Column) -> DataFrame:
        return rows.select(
            lit("binance").alias("exchange"), lit("spot").alias("market"), "symbol", lit("1h").alias("timeframe"), F.col("time").alias("open_time"), (F.col("time") + after).alias("event_time"),
            "open", "high", "low", close.alias("close"), volume.alias("volume"), closed.alias("is_closed"),
        )

    close, volume = F.col("close"), F.col("volume")
    parts = [
        update(bars, 60_000, lit(False), F.col("open"), lit(0.0)),
        update(bars, HOUR, lit(True), close, volume),
        update(bars.where(slot % 3 == 0), HOUR + 100_000, slot % 2 == 0, close, volume),
        update(bars.where(slot % 5 == 0), HOUR + 200_000, lit(True), close + 1, volume),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_OUTCOMES = f"""WITH {UPDATES} SELECT symbol, open_time, event_time, CASE WHEN event_time = open_time + 60000 THEN 'upserted' WHEN event_time = open_time + 3600000 THEN 'committed'
  WHEN event_time = open_time + 3800000 THEN 'conflict' WHEN is_closed THEN 'duplicate' ELSE 'late_open_ignored' END AS outcome FROM updates"""


@query(_OUTCOMES)
def stream_commit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return klines.commit_batch(_updates(spark, sf_dir)).select("symbol", "open_time", "event_time", "outcome")


@query(f"WITH {UPDATES} SELECT symbol, open_time, event_time FROM updates WHERE NOT is_closed AND event_time > open_time + 3600000")
def stream_late_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return klines.commit_batch(_updates(spark, sf_dir)).where("outcome = 'late_open_ignored'").select("symbol", "open_time", "event_time")


@query(f"WITH {UPDATES} SELECT symbol, open_time, max(event_time) AS event_time, arg_max(close, event_time) AS close, min(event_time) AS place, count(*) - 1 AS coalesced FROM updates GROUP BY symbol, open_time")
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = klines.coalesce_updates(_updates(spark, sf_dir).withColumn("seq", F.col("event_time")))
    return queue.select("symbol", "open_time", "event_time", "close", "place", "coalesced")


@query(f"WITH {UPDATES} SELECT symbol, max(open_time) FILTER (WHERE is_closed) AS last_closed, max(event_time) AS last_event, count(*) AS events FROM updates GROUP BY symbol")
def stream_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return klines.checkpoints(_updates(spark, sf_dir)).select("symbol", "last_closed", "last_event", "events")


def _live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The updates as a file stream, in files of the order of arrival."""
    root = _scratch(spark)
    updates = _updates(spark, sf_dir).withColumn("seq", F.col("event_time"))
    updates.write.parquet(f"{root}/in")
    return spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 10_000).parquet(f"{root}/in"), root


@query(_OUTCOMES)
def live_commit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each update of a file stream, by a state per candle."""
    stream, root = _live(spark, sf_dir)
    return klines.drained(klines.commit_stream(stream), root).select("symbol", "open_time", "event_time", "outcome")


@query(f"WITH {UPDATES} SELECT symbol, open_time, event_time FROM updates WHERE NOT is_closed AND event_time > open_time + 3600000")
def live_late_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _live(spark, sf_dir)
    return klines.drained(klines.commit_stream(stream), root).where("outcome = 'late_open_ignored'").select("symbol", "open_time", "event_time")


@query(f"WITH {UPDATES} SELECT symbol, open_time, max(event_time) AS event_time, arg_max(close, event_time) AS close, min(event_time) AS place, count(*) - 1 AS coalesced FROM updates GROUP BY symbol, open_time")
def live_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _live(spark, sf_dir)
    return klines.drained(klines.coalesce_updates(stream), root, "complete").select("symbol", "open_time", "event_time", "close", "place", "coalesced")


@query(f"WITH {UPDATES} SELECT symbol, max(open_time) FILTER (WHERE is_closed) AS last_closed, max(event_time) AS last_event, count(*) AS events, 'live' AS status FROM updates GROUP BY symbol")
def live_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _live(spark, sf_dir)
    return klines.drained(klines.checkpoints(stream), root, "complete").select("symbol", "last_closed", "last_event", "events", "status")


@query(f"""WITH o AS ({_OUTCOMES}) SELECT symbol, count(*) AS processed, count(*) FILTER (WHERE outcome = 'upserted') AS upserted, count(*) FILTER (WHERE outcome = 'committed') AS committed,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'conflict') AS conflict, count(*) FILTER (WHERE outcome = 'late_open_ignored') AS late_open_ignored FROM o GROUP BY symbol""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return klines.commit_counts(klines.commit_batch(_updates(spark, sf_dir))).select("symbol", "processed", "upserted", "committed", "duplicate", "conflict", "late_open_ignored")


_QUEUED = f"WITH {UPDATES}, queue AS (SELECT symbol, open_time, min(event_time) AS place FROM updates GROUP BY symbol, open_time), ranked AS (SELECT *, row_number() OVER (ORDER BY place DESC, symbol) AS n FROM queue)"


@query(_QUEUED + " SELECT symbol, open_time, place FROM ranked WHERE n > 100")
def stream_queue_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candles that a queue of 100 loses: those placed first."""
    queue = klines.coalesce_updates(_updates(spark, sf_dir).withColumn("seq", F.col("event_time")))
    return klines.dropped(queue, 100).select("symbol", "open_time", "place")


# --- recordings, streams that commit, derivation -----------------------------------------------------------------------


def _recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as pages of a day, in the layout of an exchange."""
    day = F.floor(F.col("time") / 86_400_000) * 86_400_000
    row = F.array(F.col("time").cast("string"), *map(_text, ("open", "high", "low", "close", "volume")))
    pages = tables.bars_1h(spark, sf_dir).groupBy("symbol", day.alias("start")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("payload"))
    return pages.select(F.lit("okx").alias("exchange"), F.lit("spot").alias("market"), "symbol", F.lit("1h").alias("timeframe"), "start", (F.col("start") + 86_400_000).alias("end"), "payload")


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume, time_close, true AS is_closed FROM bars WHERE symbol = 'CLICK' AND time >= {CUTOFF - 30 * HOUR} AND time < {CUTOFF + 30 * HOUR}")
def recorded_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of one series from a recording of all: only its pages' folders are entered."""
    path = f"{_scratch(spark)}/recording"
    recorded.record(_recording(spark, sf_dir), path)
    asked = BarQuery(Instrument("okx", "spot", "CLICK"), timeframe.Timeframe.parse("1h"), CUTOFF - 30 * HOUR, CUTOFF + 30 * HOUR)
    return recorded.recorded(spark, path)(asked).select("symbol", "time", "open", "high", "low", "close", "volume", "time_close", "is_closed")


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume FROM bars")
def recorded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording in five batches as a stream, which stops after each and goes on from its checkpoint."""
    root = _scratch(spark)
    recorded.register(spark)
    pages = _recording(spark, sf_dir)
    for k in range(5):
        recorded.record(pages.where(F.pmod(F.col("start") / 86_400_000, F.lit(5)) == k), f"{root}/recording")
        stream = recorded.bars_of_pages(spark.readStream.format("klines").load(f"{root}/recording"), "okx", "1h")
        found = klines.drained(stream, root)
    return found.select("symbol", "time", "open", "high", "low", "close", "volume")


def _arriving(spark: SparkSession, updates: DataFrame) -> tuple[DataFrame, str]:
    """Updates as a file stream of six files, by time of the event, one file to a micro-batch."""
    root = _scratch(spark)
    rows = updates.withColumn("seq", F.col("event_time")).persist()
    span = rows.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b")).first()
    step = (span["b"] - span["a"]) // 6 + 1
    for k in range(6):
        part = rows.where((F.col("event_time") >= span["a"] + k * step) & (F.col("event_time") < span["a"] + (k + 1) * step))
        part.repartition(1).write.parquet(f"{root}/in/slice={k}")
    rows.unpersist()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/slice=*"), root


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume, time_close FROM bars")
def live_store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live updates over six micro-batches into a store: the first close of each candle, once."""
    stream, root = _arriving(spark, _updates(spark, sf_dir))
    store = BarStore(spark, f"{root}/store")
    live.into_store(stream, live.StoreSink(store, "live"), f"{root}/state")
    return store.read_all().select("symbol", "time", "open", "high", "low", "close", "volume", "time_close")


@query(f"""WITH {UPDATES}, arrived AS (SELECT * FROM updates WHERE event_time < (SELECT max(open_time) FROM updates) + 1800000)
       SELECT symbol, open_time, max(event_time) AS event_time, arg_max(close, event_time) AS close FROM arrived GROUP BY symbol, open_time HAVING NOT bool_or(is_closed)""")
def live_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candles that are still open when the stream stops amid an hour, from the state of its last micro-batch."""
    updates = _updates(spark, sf_dir)
    last = updates.agg(F.max("open_time").alias("t")).first()["t"]
    stream, root = _arriving(spark, updates.where(F.col("event_time") < last + HOUR // 2))
    live.into_store(stream, live.StoreSink(BarStore(spark, f"{root}/store"), "live"), f"{root}/state")
    return live.current(spark, f"{root}/state").select("symbol", "open_time", "event_time", "close")


@query(_resampled_sql(24 * HOUR))
def derived_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a store of hourly ones, derived, and brought up to date after two appends by the days that those touch."""
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1h")}
    bars = tables.bars_1h(spark, sf_dir).withColumns(names)
    root = _scratch(spark)
    base, days = BarStore(spark, f"{root}/hours"), BarStore(spark, f"{root}/days")
    bounds = [None, CUTOFF, CUTOFF + 5 * HOUR, None]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = bars if a is None else bars.where(F.col("time") >= a)
        base.append_newer(part if b is None else part.where(F.col("time") < b))
        derived.derive(base, days, "1D", source="1h")
    return days.read_all().select("symbol", "time", "open", "high", "low", "close", "volume", "time_close")


@query(f"WITH {LEVELS} SELECT symbol, time, price_low, buy_volume, sell_volume, buy_count, sell_count FROM levels WHERE symbol = 'PURCHASE'")
def footprint_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All footprints of one instrument from a cache of its trades that half the time range had filled before."""
    trades = tables.trades(spark, sf_dir).where("symbol = 'PURCHASE'")
    span = trades.agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    start, end = span["a"] - span["a"] % HOUR, span["b"] - span["b"] % HOUR + HOUR
    instrument, cache = Instrument("binance", "spot", "PURCHASE"), TradeCache(spark, f"{_scratch(spark)}/trades")
    cache.get(instrument, start, start + (end - start) // 2, lambda a, b: in_range(trades, a, b))
    asked = FootprintQuery(instrument, timeframe.Timeframe.parse("1h"), start, end, 10.0, gap_policy="allow_with_metadata")
    found = cached_footprint(asked, cache, lambda a, b: in_range(trades, a, b))
    return found.levels.select("symbol", "time", "price_low", "buy_volume", "sell_volume", "buy_count", "sell_count")


@query(f"WITH {BARS} SELECT symbol, time, open, high, low, close, volume, time_close FROM bars WHERE time >= {CUTOFF}")
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series cached as segments, then replaced by their bars from the cutoff on, and read back against their checksums."""
    names = {"exchange": F.lit("binance"), "market": F.lit("spot"), "timeframe": F.lit("1h")}
    bars = tables.bars_1h(spark, sf_dir).withColumns(names)
    cache = SegmentCache(spark, f"{_scratch(spark)}/cache")
    cache.write(bars)
    cache.write(bars.where(F.col("time") >= CUTOFF), start=CUTOFF)
    return cache.read_all().where(F.col("time") >= CUTOFF).select("symbol", "time", "open", "high", "low", "close", "volume", "time_close")


@query(f"""WITH {SYMBOLS} SELECT p_partkey, CASE WHEN perp THEN 'wss://fstream.binancefuture.com/ws/' ELSE 'wss://stream.binance.com:9443/ws/' END || lower(base || quote) || '@kline_1h' AS url,
       'kline.60.' || base || quote AS topic, CASE WHEN perp OR contains(base || quote, 'USDT') THEN 'usdt' ELSE lower(base || quote) END AS settled FROM symbols""")
def kline_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the live candles of every symbol come from at two exchanges, and in what its contract would be settled."""
    rows = symbols.normalise_symbols(tables.symbols(spark, sf_dir).drop("name"), "binance")
    market = F.when(F.col("is_perpetual"), "linear").otherwise(F.col("market"))
    binance = identity.kline_stream("binance", F.col("market"), F.col("exchange_symbol"), "1h")
    bybit = identity.kline_stream("bybit", market, F.col("exchange_symbol"), "1h")
    return rows.select("p_partkey", binance.url.alias("url"), bybit.topic.alias("topic"), identity.settlement(F.col("exchange_symbol"), market).alias("settled"))


@query("""WITH named AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN repeat('0', 40) WHEN 1 THEN upper(md5(CAST(o_orderkey AS VARCHAR))) || 'abcdefab' WHEN 2 THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE md5(CAST(o_orderkey AS VARCHAR)) || '01234567' END AS commit_,
       CASE o_orderkey % 7 WHEN 0 THEN md5(o_orderpriority) || md5(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN NULL ELSE 'sha256:' || md5(o_orderpriority) || md5(CAST(o_orderkey AS VARCHAR)) END AS stack FROM orders)
       SELECT o_orderkey, coalesce(regexp_full_match(commit_, '[0-9a-f]{40}') AND commit_ <> repeat('0', 40) AND regexp_full_match(stack, 'sha256:[0-9a-f]{64}'), false) AS known FROM named""")
def artifact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders, read as artifacts with made-up producers, name theirs exactly."""
    digest = F.md5(F.col("o_orderkey").cast("string"))
    commit = F.when(F.col("o_orderkey") % 5 == 0, "0" * 40).when(F.col("o_orderkey") % 5 == 1, F.concat(F.upper(digest), F.lit("abcdefab")))
    commit = commit.when(F.col("o_orderkey") % 5 == 2, digest).otherwise(F.concat(digest, F.lit("01234567")))
    both = F.concat(F.md5("o_orderpriority"), digest)
    stack = F.when(F.col("o_orderkey") % 7 == 0, both).when(F.col("o_orderkey") % 7 != 1, F.concat(F.lit("sha256:"), both))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", identity.artifact_known(commit, stack).alias("known"))
