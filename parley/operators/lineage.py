"""Cutting the lineage of a table through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read back from there; Spark removes the files when nothing refers to them.

    Only in local mode a folder of this machine is set where none is.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/parley-checkpoints")
    held = df.persist(StorageLevel.DISK_ONLY)  # else it would be worked out twice, to be counted and to be written
    out = held.checkpoint()
    held.unpersist()
    return out
