"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. One of this machine stands in only where driver and executors are one process, as in tests; else ``RuntimeError``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="nearfield-")
        context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4()}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` as rows in the shared checkpoint folder: its partitions and their order no longer change."""
    _folder(df.sparkSession)
    return df.checkpoint()
