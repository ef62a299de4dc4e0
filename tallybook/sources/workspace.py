"""Folders for stream checkpoints and written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, unique to this call, under the shared folder the session names.

    Every executor must reach it, and it must outlive any of them. A temporary folder
    of this machine is used only in local mode with no setting; elsewhere that is an error.
    """
    shared = spark.conf.get(CHECKPOINT_SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tallybook-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
