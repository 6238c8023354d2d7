"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; under a temporary one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"
