"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candela.llm.common import ship

#: Query name: module of this subpackage. The module's SQL is the query's twin, where there is one.
MODULES = {
    "op1_decontamination": "decontaminate",
    "op2_deleted_interpolation": "lm_score",
    "op3_kn_toxicity": "toxicity",
    "op4_chat_round_trip": "chat",
    "op5_warc_revisits": "warc",
    "op6_frequency_bytes": "token_files",
    "op7_exact_dedup": "exact_dedup",
    "op8_sampled_shards": "shards",
    "op9_bpe_trie": "bpe",
    "op10_minhash_dedup": "near_dedup",
    "op11_token_alignment": "align",
    "op12_compression_quality": "quality",
    "op13_spelling_variants": "variants",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return getattr(importlib.import_module(f"candela.llm.{MODULES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"candela.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
