"""A document cleaning pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candela.llm.bpe import bpe_digests
from candela.llm.common import remove, settle, ship, table
from candela.llm.decontaminate import decontaminate
from candela.llm.exact_dedup import exact_dedup
from candela.llm.near_dedup import near_dedup
from candela.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are predicted toxic, as learned from ``labels``; see ``drop_toxic`` for odd rows."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null being equal to the empty text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; texts without words stay."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item of ``benchmark``; empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of BPE tokens of each remaining document, with digests of its ids and of their decoding; null counts as empty."""
    return bpe_digests(docs, slice_bytes=4 << 20)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", benchmark),
    ("bpe encoding", encode),
]

#: SQL has no words for the learned, approximate and tokenising stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result is written; then what it was made from is deleted.

    Null and empty texts count as equal, so one of them goes through to the end. Repeated rows are equal texts. Texts of any
    length are read whole at every stage. An empty table gives an empty result. Further columns of ``documents`` may have any
    name and go unchanged through all stages but the last, which returns its own.
    """
    ship(spark)
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, made = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if path:
            remove(spark, path)
        path = made
    return STAGES[-1][1](spark, docs, sf_dir)
