"""Balanced shards by sampled splitters: quantile boundaries from a size-weighted key sample, overfull ranges subdivided."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from candela.llm.common import materialize, ship, table, text_of

#: Keys drawn per range on average, rows that a range should hold, and times this that it may hold. Rows are narrow here: a range
#: is some 50 MB, and 5e10 documents take 50,000 ranges and 800,000 drawn keys, 13 MB.
DRAWS, RANGE_ROWS, OVERFULL = 16, 1_000_000, 2
#: What a group of equal texts that is kept whole may move a shard's end by, as a part of the shard.
SLACK = 0.025


@dataclass
class Splitters:
    """Sorted boundaries over the key (hash of the text, tie): a row's range is the number of boundaries at or below its key."""

    first: np.ndarray
    tie: np.ndarray

    def place(self, first: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.first, first, side="left")
        high = np.searchsorted(self.first, first, side="right")
        out = low.copy()
        for value in np.unique(first[low < high]):  # few: only texts that boundaries cut through
            own = np.flatnonzero(first == value)
            a, b = low[own[0]], high[own[0]]
            out[own] = a + np.searchsorted(self.tie[a:b], tie[own], side="right")
        return out

    def merged(self, first: np.ndarray, tie: np.ndarray) -> Splitters:
        keys = sorted({*zip(self.first.tolist(), self.tie.tolist(), strict=True), *zip(first.tolist(), tie.tolist(), strict=True)})
        return Splitters(np.array([k for k, _ in keys], np.int64), np.array([t for _, t in keys], np.int64))


LOWEST = np.iinfo(np.int64).min


def _quantiles(first: np.ndarray, tie: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries at the quantiles of a sample: at the start of a text, except in a text that several of them fall into."""
    order = np.lexsort((tie, first))
    first, tie = first[order], tie[order]
    at = np.unique(np.arange(1, ranges) * len(first) // ranges)
    cut, ties = first[at], tie[at]
    many = np.isin(cut, [v for v, n in zip(*np.unique(cut, return_counts=True), strict=True) if n > 1])
    return cut, np.where(many, ties, LOWEST)


def _ranged(rows: DataFrame, splitters: Splitters) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.place(np.asarray(batch.column("key")), np.asarray(batch.column("tie")))
            yield batch.append_column("range", pa.array(found.astype(np.int64)))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("range", T.LongType())]))


def _sample(rows: DataFrame, weight: F.Column, total: float, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows drawn with a chance in proportion to ``weight``; about ``draws`` of them, whatever the table's size."""
    chance = F.lit(draws / max(total, 1)) * weight
    luck = F.pmod(F.xxhash64("key", "tie", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(luck < chance).select("key", "tie").toArrow()
    return (np.asarray(drawn.column(k).combine_chunks()) for k in ("key", "tie"))


def shard_documents(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", law: str = "bytes", range_rows: int = RANGE_ROWS, slack: float = SLACK,
) -> DataFrame:
    """One row per input row: the id, ``size, text_crc32, law, shard, slot, grown_shard``.

    The key is a hash of the text, then one of the id, so equal texts lie side by side. A sample drawn by size gives the
    boundaries of many ranges, far more than shards; rows are dealt to them, and a range that holds too many rows gets
    further boundaries from a sample of its own, also within one text, until none holds too many. Sums per range and a sort within each then say
    where in the whole order a row stands, by bytes (law ``bytes``) or rows (law ``rows``), and so its shard and slot.

    By law ``bytes`` a shard's end is off by half a record, or by half a group of equal texts, which stays together wherever
    that moves the end by ``slack`` of a shard at most, however many ranges it lies in; the law has a larger group cut. So a
    shard's size differs from the mean by one record or 2 * slack of it. By law ``rows`` counts differ by one at most. Null
    counts as the empty text, of size 1. Rows that repeat an id and text stand in any order, each with a slot of its own. A
    null id is an id. A text of any length is one record. An empty table gives an empty result; other columns are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    ship(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
        # The last bits tell rows apart that repeat id and text, so that they can be subdivided too.
        F.xxhash64(id_col, F.lit(3)).bitwiseAND(~0xFFFFF).bitwiseOR(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).alias("tie"),
    )
    rows = materialize(rows, "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    weight = F.col("size") if law == "bytes" else F.lit(1)
    ranges = max(shards * 4, -(-count // range_rows))
    splitters = Splitters(np.zeros(0, np.int64), np.zeros(0, np.int64)).merged(
        *_quantiles(*_sample(rows, weight, total if law == "bytes" else count, DRAWS * ranges), ranges)
    ) if count > ranges else Splitters(np.zeros(0, np.int64), np.zeros(0, np.int64))
    while True:
        ranged = materialize(_ranged(rows, splitters), "shard-ranges")
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("range")
        over = sums[sums["n"] > OVERFULL * range_rows]
        if over.empty:
            break
        within = ranged.join(docs.sparkSession.createDataFrame(over[["range"]].astype("int64")), "range")
        parts = int(np.ceil(over["n"].sum() / range_rows)) * 2
        more = splitters.merged(*_quantiles(*_sample(within, F.lit(1), float(over["n"].sum()), DRAWS * parts), parts))
        if len(more.first) == len(splitters.first):
            break
        splitters = more
    # One row per range: their number follows from the table's rows, not from its bytes.
    sums["before_bytes"] = sums["bytes"].cumsum() - sums["bytes"]
    sums["before_rows"] = sums["n"].cumsum() - sums["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(sums[["range", "before_bytes", "before_rows"]].astype("int64")) if len(sums) else None
    if offsets is None:
        return rows.select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    order = Window.partitionBy("range").orderBy("key", "tie", "id", "size")
    group = Window.partitionBy("range", "key")
    placed = ranged.join(F.broadcast(offsets), "range").withColumns(
        {
            "end": F.col("before_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "row": F.col("before_rows") + F.row_number().over(order) - 1,
        }
    )
    if law == "bytes":
        placed = placed.withColumns({"group_end": F.max("end").over(group), "group_bytes": F.sum("size").over(group)})
        # A text that boundaries cut through lies in several ranges: its group's end and size come from all of them.
        cut = np.unique(splitters.first[splitters.tie != LOWEST])
        if len(cut):
            keys = spark.createDataFrame([(int(k),) for k in cut], "key long")
            # At most one text per boundary, so no more than the splitters that every task holds already.
            parts_of = placed.join(F.broadcast(keys), "key").groupBy("key", "range").agg(F.max("group_end").alias("e"), F.max("group_bytes").alias("b"))
            over_all = parts_of.groupBy("key").agg(F.max("e").alias("e"), F.sum("b").alias("b"))  # a row per text cut, few
            placed = placed.join(F.broadcast(over_all), "key", "left")
            placed = placed.withColumns({"group_end": F.coalesce("e", "group_end"), "group_bytes": F.coalesce("b", "group_bytes")}).drop("e", "b")
        small = F.col("group_bytes") <= 2 * slack * total / shards
        middle = F.when(small, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
        shard = F.least(F.floor(middle * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int")
    else:
        shard = F.floor(F.col("row") * shards / F.lit(float(count))).cast("int")
    placed = materialize(placed.select("id", "size", "crc", "row", shard.alias("shard")), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
