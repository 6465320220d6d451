"""Cut long lineage by writing a stage to the shared checkpoint folder.

A written stage survives lost executors and is computed once, however many
later results read it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = getattr(checkpoint_folder, "local", None) or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    checkpoint_folder.local = folder
    return folder


_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Stages written inside are deleted at the end, when their readers are done."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder, deleted with the scope it is made in."""
    path = f"{checkpoint_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan with too few splits for them.

    Big tables have more splits than the cluster has cores and pass through
    untouched; only a small file about to meet costly row work is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
