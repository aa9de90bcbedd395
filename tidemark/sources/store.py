"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir where the cluster names one, else a folder of a session on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))  # only where no folder is named, as in tests
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors. Within scratch() it is deleted at the end."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were stored within it; results that read them are written before it ends."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_WRITTEN) > before:
            path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(conf).delete(path, True)
