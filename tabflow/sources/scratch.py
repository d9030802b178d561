"""Folders for tables on their way: in the folder that the cluster shares, if it names one."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only where that is unset and all tasks run here, in a temporary folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="tabflow-"))
            atexit.register(_OWN[0].cleanup)
        shared = f"file://{_OWN[0].name}"
    return f"{shared.rstrip('/')}/tabflow-{uuid.uuid4().hex}"


def local_path(spark: SparkSession, ending: str) -> str:
    """The same as a plain path, for formats that only Python's own drivers write."""
    path = folder(spark)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{ending} files need a shared folder that is a file system's, not {path}")
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path + ending
