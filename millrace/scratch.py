"""Folders that driver and executors share, for checkpoints and tables written on the way."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset in local mode (tests), below a new local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        root = _local_dir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='millrace-')}"
