"""Cutting lineage in loops: checkpoints in the folder that the session names, never local ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="atlasq-"))
    return spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{_base(spark).rstrip('/')}/atlasq-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared checkpoint folder."""
    _base(df.sparkSession)
    return df.checkpoint()
