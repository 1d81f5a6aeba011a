"""Intermediate tables in the cluster's shared checkpoint folder.

A written table cuts lineage, survives the loss of any executor, and is read back with column
pruning. The folder is the one named by ``spark.checkpoint.dir``; a session without that setting
uses a folder under its warehouse.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders of the runs that are open; tables stored outside a run stay until the session's owner removes them.
_open_runs: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    folder = _open_runs[-1] if _open_runs else "tables"
    return f"{checkpoint_root(spark)}/{folder}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the stored copy."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block lie in a folder of their own, and only that folder goes at its end."""
    run = f"run-{uuid.uuid4().hex}"
    _open_runs.append(run)
    try:
        yield
    finally:
        _open_runs.remove(run)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{run}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
