"""Collects queries with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import derive

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def query(name: str, sql: str | None, *inputs: str):
    """Registers f(*relations) under name; inputs are derived relations, or t:<table>. In sql, {name} stands for one."""

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            frames = [spark.read.parquet(f"{sf_dir}/{i[2:]}.parquet") if i.startswith("t:") else derive.relation(spark, sf_dir, i) for i in inputs]
            return f(*frames)

        QUERIES[name] = run
        if sql:
            text = sql
            for r in derive.RELATIONS:
                text = text.replace("{" + r + "}", derive.sql(r))
            SQL[name] = text
        return f

    return take
