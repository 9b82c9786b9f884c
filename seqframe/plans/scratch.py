"""Folders that the driver and the executors share, for queries that write text and read it back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below `spark.checkpoint.dir`. Without that setting: below a local folder if all tasks run in this process, else an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="seqframe-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/seqframe/{name}-{uuid.uuid4().hex}"
