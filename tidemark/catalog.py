"""Registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import call_queries, change_queries, context_queries, flow_queries, hierarchy_queries, registry, report_queries, review_queries, source_queries, symbol_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["j09_tracked_flows"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
