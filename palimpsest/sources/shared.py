"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder of spark.checkpoint.dir (or of setCheckpointDir) that nothing
    else uses; where there is none, in a temporary folder, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
