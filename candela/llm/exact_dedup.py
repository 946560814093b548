"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import materialize, table, text_of

#: Digest groups are merged in this many salted parts before their winners meet.
SALTS = 16


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns(
        {
            "__id": F.col(id_col),
            "__text": text_of(text_col),
            "__digest": F.unhex(F.sha2(text_of(text_col), 256)),
            "__check": F.xxhash64(text_of(text_col), F.length(text_of(text_col))),
        }
    )


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """Of every text that occurs more than once: its keys, largest id and number of rows."""
    salted = (
        rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("__digest", "__salt", "__text", "__check")
        .agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    )
    whole = salted.groupBy("__digest", "__text", "__check").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    # Rows find their group by digest and check; that these two stand for one text only is proved here, not assumed.
    proved = whole.groupBy("__digest", "__check").agg(
        F.max("__keep").alias("__keep"),
        F.sum("__n").alias("__size"),
        F.count(F.lit(1)).alias("__texts"),
    )
    clash = F.raise_error(F.lit("two different texts share SHA-256 and a 64-bit hash")).cast("long")
    return proved.withColumn("__size", F.when(F.col("__texts") == 1, F.col("__size")).otherwise(clash)).where("__size > 1").drop("__texts")


def _placed(rows: DataFrame, winners: DataFrame, salts: int) -> DataFrame:
    """Rows with their group, a hot group being looked up from ``salts`` copies of its one winner."""
    spread = winners.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
        .join(spread, ["__digest", "__check", "__salt"], "left")
        .withColumn("__keep", F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")))
        .withColumn("__kept", F.col("__id").eqNullSafe(F.col("__keep")))
    )


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: the id, ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as the empty text. The row with the largest id of its group
    stays; rows that repeat this id as well all say ``kept`` (``exact_dedup`` leaves one of them). A null id is below
    every other. Other columns are ignored; an empty table gives an empty result.

    1. Each task combines its own rows by digest and full text, under a salt drawn from its partition.
    2. The salted groups of a digest are merged by digest and full text, so a hot text is spread over ``salts`` tasks.
    3. At most ``salts`` winners per text are combined, again by digest and full text.

    Then rows look up their winner by digest, on a salt of their own id; texts don't travel there.
    """
    rows = _with_keys(docs, id_col, text_col)
    winners = materialize(_winners(rows.select("__id", "__text", "__digest", "__check"), salts), "exact-winners")
    return _placed(rows.select("__id", "__digest", "__check"), winners, salts).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one row of each group of equal texts, the one of the largest id.

    Whole rows are combined: in each task, then in ``salts`` parts of each digest, then over these, always by digest and full
    text, so what the last stage leaves is the result and nothing is looked up. A row crosses at most two shuffles, and of a
    hot text a task sends one row. Null counts as the empty text and comes out as it was. A null id is below every other; of
    rows that repeat text and id the one of the largest hash of its other columns stays (maps left aside). An empty table
    gives an empty result. Rows travel as one struct, so no column of theirs can clash with a name used here.
    """
    text = text_of(text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    plain = [F.col(f"`{c}`") for c in docs.columns if c != text_col and "map<" not in docs.schema[c].dataType.simpleString()]
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        text.alias("text"),
        F.struct(F.col(f"`{text_col}`").isNull().alias("empty"), F.struct(*rest).alias("rest")).alias("row"),
        F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(*plain).alias("tie")).alias("rank"),
    )
    salted = rows.groupBy("digest", "text", "salt").agg(*best)
    whole = salted.groupBy("digest", "text").agg(*best)
    kind = docs.schema[text_col].dataType
    out = [
        F.when(~F.col("row.empty"), F.col("text")).cast(kind).alias(c) if c == text_col else F.col("row.rest").getField(c).alias(c) for c in docs.columns
    ]
    return whole.select(*out)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
