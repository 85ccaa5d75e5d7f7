"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one for checkpoints.

    Where ``spark.checkpoint.dir`` is missing and the session runs on this
    machine alone, a new temporary folder is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def work_table(df: DataFrame, *by: str) -> Iterator[str]:
    """Writes ``df`` as Parquet, one folder per value of ``by``, and gives the path; it is deleted at the end, so nothing may read it later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    try:
        yield path
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
