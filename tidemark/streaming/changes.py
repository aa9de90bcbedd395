"""Batch operators over a stream of scope or finding files (an extension; a change is one batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def each_change(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs handle(rows, batch) once for every set of new JSON files in folder; restarts go on from the checkpoint."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
