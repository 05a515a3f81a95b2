"""Whole workloads, composed from the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, set from spark.checkpoint.dir.

    Only where all tasks run in the driver, as in tests, a local folder stands in for one
    that is not configured; a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the shared folder, and read it back.

    A checkpoint takes several times the disk of such a file and hands on the estimated size of
    its plan, which every join of the table with itself squares; a table that is read has the size
    of its files. The write's own shuffle files go when it ends, not when the driver collects its garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4()}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
