"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
#: Where staged tables lie, by the frame that reads them.
_PATHS: dict[int, str] = {}
#: Setting by which Spark deletes an execution's shuffle files as soon as it ends, and how many writes want it now.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WANTED = threading.Lock(), {"n": 0, "before": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is not set: a temporary one for a local session, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lithic-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """While it lasts, the shuffle files of an execution go when it ends: what was written is read from its files from then on."""
    with _LOCK:
        if not _WANTED["n"]:
            _WANTED["before"] = spark.conf.get(_CLEAN, "false")
        _WANTED["n"] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WANTED["n"] -= 1
            if not _WANTED["n"]:
                spark.conf.set(_CLEAN, _WANTED["before"])


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    if not _MADE:
        atexit.register(_drop)
    path = f"{shared_dir(spark)}/lithic/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """`df` written once: what reads it does not compute it again, and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; other tables are left alone."""
    if path := _PATHS.pop(id(df), None):
        fs, target = file_system(df.sparkSession, path)
        fs.delete(target, True)


def _drop() -> None:
    for spark, path in _MADE:
        try:
            fs, target = file_system(spark, path)
            fs.delete(target, True)
        except Exception:  # the session may have ended before the interpreter
            return
