"""Trades, ticks and bars as derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.resample import bars_from_trades


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"), F.unix_millis(at).alias("time"), F.unix_micros(at).alias("micros"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("quantity"), (F.col("user_id") % 2 == 1).alias("buyer_maker"), F.upper("event_type").alias("symbol"),
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_trades(trades(spark, sf_dir), "1h")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as daily ticks over several years, one series per priority."""
    day = F.unix_millis(F.to_timestamp(F.col("o_orderdate").cast("date")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), day.alias("time"), F.col("o_totalprice").alias("price"), F.lit(1).alias("quantity"),
        (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 10_000_000_000 + F.col("o_orderkey")).alias("micros"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions of one bar per order: the first is the original, returned ones revoke."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    ranked = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(order).cast("long"))
    revision = F.col("seq") - 1
    state = F.when(revision == 0, "ORIGINAL").when(F.col("l_returnflag") == "R", "REVOKED").otherwise("CORRECTED")
    return ranked.select(
        F.lit("TPCH").alias("series"), (F.col("l_orderkey") * 60_000).alias("time"), "seq", revision.alias("revision"), state.alias("revision_state"),
        F.col("l_extendedprice").cast("double").alias("close"), F.lit("binance").alias("provider"),
    ).withColumn("content_hash", F.sha2(F.concat_ws("|", "time", "revision", "revision_state"), 256))


def ruled_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions with lineage, of which the order's key bends some: each rule of a chain is broken by one remainder."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    n, k = F.col("n"), F.col("l_orderkey") % 8
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order).cast("long") - 1)
    name = lambda place: F.concat_ws(".", F.lit("h"), F.col("l_orderkey"), place)
    state = F.when(n == 0, F.when(k == 4, "CORRECTED").otherwise("ORIGINAL")).when(F.col("l_returnflag") == "R", "REVOKED").otherwise("CORRECTED")
    number = F.when((k == 2) & (n > 1), F.lit(1)).when(k == 3, 10 - n).otherwise(n)
    made = rows.select(
        F.lit("TPCH").alias("series"), (F.col("l_orderkey") * 60_000).alias("time"), (n * 2).alias("seq"), number.alias("revision"), state.alias("revision_state"),
        F.col("l_extendedprice").cast("double").alias("close"), F.when((k == 1) & (n == 1), "bybit").otherwise("binance").alias("provider"), name(n).alias("content_hash"),
        F.when(n > 0, F.when((k == 5) & (n == 1), "other").otherwise(name(n - 1))).alias("superseded_bar_hash"),
    )
    again = made.where((F.col("time") / 60_000) % 8 == 6).withColumn("seq", F.col("seq") + 1)
    return made.unionByName(again)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands as symbols with a quote asset, some of them perpetual."""
    from candela.functions.identity import STABLE_QUOTES

    quotes = F.array(*map(F.lit, STABLE_QUOTES))
    base = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    quote = quotes[(F.col("p_partkey") % len(STABLE_QUOTES)).cast("int")]
    name = F.concat(base, quote, F.when(F.col("p_size") % 5 == 0, ".P").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("symbol"), F.col("p_name").alias("name"))
