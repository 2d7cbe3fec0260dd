"""Cutting the lineage of iterative plans in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Writes the frame to the checkpoint folder; a lost executor's part is read again from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share; a temporary one under a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"
