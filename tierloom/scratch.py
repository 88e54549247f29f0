"""Folders that the driver and all executors share, for what a run writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without it an error, but in local mode, where all share a disk."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if root is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="tierloom-checkpoint-"))
    return root or context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
