"""Intermediate tables written to the cluster's shared folder.

A staged table cuts lineage, survives the loss of executors, keeps column pruning, and gives the
planner real sizes, so that Spark itself decides by size whether a side may be broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_folders: dict[str, str] = {}
_runs: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="origintrace-")
    return _local_folders[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    within = [spark.sparkContext.applicationId, *_runs[-1:]]
    return "/".join([shared_folder(spark), "origintrace", *within, f"{name}-{uuid.uuid4().hex[:12]}"])


def staged_path(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet and return the folder."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return the written table."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a table of classes, countries or the like is sent to every executor.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` staged, and marked for broadcast if it has at most ``rows`` rows; else joined as Spark sees fit."""
    staged = stage(df, name)
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> Iterator[None]:
    """For what is written inside: Arrow batches of so many rows and bytes at most, as whole texts go to Python.

    What a Python worker needs goes with the texts of one batch, 10,000 by default. The session's settings come back.
    """
    asked = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever is staged inside; results must have been written or collected by then."""
    run = uuid.uuid4().hex[:12]
    _runs.append(run)
    try:
        yield
    finally:
        _runs.remove(run)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/origintrace/{spark.sparkContext.applicationId}/{run}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
