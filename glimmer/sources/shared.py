"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a folder of this machine only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), f'glimmer-{os.getpid()}')}"
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"
