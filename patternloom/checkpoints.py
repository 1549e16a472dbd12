"""Cutting lineage: reliable checkpoints in the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in spark.checkpoint.dir; a temporary one where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="patternloom-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
