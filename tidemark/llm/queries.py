"""The corpus queries opN_<name> and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("token_counts", "substring_dedup", "pii", "exact_dedup", "near_dedup", "byte_bpe", "decontaminate", "line_dedup", "token_file", "quality_cnn", "fill_in_middle", "centroid_clustering", "suffix_array_dedup")


def _modules():
    return [importlib.import_module(f"tidemark.llm.{m}") for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}
