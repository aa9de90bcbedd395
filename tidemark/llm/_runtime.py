"""Session plumbing shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bounds of an Arrow batch, by rows and, for long texts, by bytes; set where the session has Spark's own defaults.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(4 << 20))}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small enough for long texts.

    A plan is run after the call that makes it returns, so the bounds stay with the session; a
    bound that its user has chosen is left alone.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    for key, (usual, wanted) in _BATCH.items():
        now = spark.conf.get(key, usual)
        if now.rstrip("b") == usual:
            spark.conf.set(key, wanted)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir where the cluster names one.

    A session on one machine that names none, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors. With the path, for delete()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all results so far. For callers that have written those results."""
    for path in list(_WRITTEN):
        delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
