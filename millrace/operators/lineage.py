"""Rounds without growing plans, and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_lock = threading.Lock()
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a single machine without one, a temporary folder that goes when Python ends.

    A cluster without the setting has no folder that every executor can read, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _lock:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
