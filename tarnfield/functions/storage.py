"""Where steps keep rows between jobs: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, it is a new one of this machine in local mode, and an error on a cluster."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(rows: DataFrame) -> DataFrame:
    """The same rows in the same partitions, written to the shared folder and read from there."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
