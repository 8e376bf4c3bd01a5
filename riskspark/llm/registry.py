"""Queries of the numbered text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


#: query name: (module, function)
OPERATORS = {
    "op1_mix_sources": ("mixing", "op1"),
    "op2_exact_dedup": ("exact_dedup", "op2"),
    "op3_near_dedup": ("near_dedup", "op3"),
    "op4_fingerprints": ("fingerprints", "op4"),
    "op5_sharding": ("sharding", "op5"),
    "op6_toxicity": ("toxicity", "op6"),
    "op7_language_id": ("language_id", "op7"),
    "op8_lm_scoring": ("lm_scoring", "op8"),
    "op9_bpe": ("bpe", "op9"),
    "op10_pii": ("pii", "op10"),
    "op11_vector_dedup": ("vector_dedup", "op11"),
    "op12_repair": ("repair", "op12"),
    "op13_whitening": ("whitening", "op13"),
}


def _query(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"riskspark.llm.{module}"), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*where) for name, where in OPERATORS.items()}


#: Modules with SQL for their query; the others are not imported for it, so what one of them needs may be missing.
WITH_SQL = {"op2_exact_dedup": "exact_dedup", "op12_repair": "repair"}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"riskspark.llm.{module}").ORACLE_SQL for name, module in WITH_SQL.items()}
