"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leafgrid-shared-")
    return base


def fresh_folder(spark: SparkSession, name: str = "stream") -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint: read by several branches, released by Spark's cleaner, and safe when executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)
