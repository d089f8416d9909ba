"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that defines it.
MODULES = {
    "op1_language_id": "langid",
    "op2_token_files": "token_files",
    "op3_lm_score": "brown_lm",
    "op4_simhash": "simhash",
    "op5_embedding_dedup": "embed_dedup",
    "op6_packing": "packing",
    "op7_bpe_round_trip": "transducer",
    "op8_token_counts": "token_counts",
    "op9_line_dedup": "line_dedup",
    "op10_imatch": "imatch",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
