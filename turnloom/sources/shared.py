"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder, on a local master only.

    On a cluster each machine would write to a folder of its own, so there an unset folder is an error.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="turnloom-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_root(spark)}/turnloom-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
