"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.shared import delete, shared_root

_shipped: str | None = None


def ship(spark: SparkSession) -> None:
    """Gives executors the package's modules, once per application."""
    global _shipped
    context = spark.sparkContext
    if _shipped == context.applicationId:
        return
    package = Path(__file__).parents[1]
    archive = Path(tempfile.mkdtemp(prefix="turnloom-code-")) / "turnloom_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped = context.applicationId


#: Folders that are still there, with the session that wrote them.
_roots: dict[str, SparkSession] = {}


def cleanup() -> None:
    """Deletes all tables of this application that are left; results that were not written elsewhere are lost."""
    while _roots:
        root, spark = _roots.popitem()
        delete(spark, root)


@atexit.register
def _at_exit() -> None:
    try:
        cleanup()
    except (Py4JError, OSError):  # the JVM is gone: what is left lies in the folder for temporary tables
        _roots.clear()


#: Whether Spark deletes the shuffle files of an execution when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables that cut lineage: each is computed once, written, and read back.

    A written table survives the loss of executors, unlike cached blocks. With
    the table there, the shuffle files that led to it are deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_root(spark)}/turnloom-{uuid.uuid4().hex}"
        _roots[self.root] = spark
        self._n = 0

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._turnloom_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later step reads."""
        for table in tables:
            delete(self.spark, table._turnloom_path)

    def close(self) -> None:
        """Deletes all tables written here."""
        if _roots.pop(self.root, None) is not None:
            delete(self.spark, self.root)


def settled(spark: SparkSession, build: Callable[[Workspace], DataFrame], codec: str = "zstd") -> DataFrame:
    """The result of build(workspace), written to a table of its own; all other tables that it wrote are deleted.

    The result's table is left until it is released or the application ends.
    """
    work, out = Workspace(spark), Workspace(spark)
    try:
        result = out.keep(build(work), "result", codec)
        result._turnloom_result = out
        return result
    finally:
        work.close()


def release(result: DataFrame) -> None:
    """Deletes the table of a settled result that nothing reads any more; other tables are left alone."""
    out = getattr(result, "_turnloom_result", None)
    if out is not None:
        out.close()
