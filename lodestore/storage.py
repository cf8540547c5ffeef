"""Where the engine may write tables of its own."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a temporary folder only where that is unset and local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lodestore-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    return f"{shared}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """As ``scratch_path``, made, as a path of the file system that the driver and all executors mount; else an error."""
    path = scratch_path(spark, name).removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} is no mounted folder")
    os.makedirs(path, exist_ok=True)
    return path
