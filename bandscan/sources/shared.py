"""Folders that all machines of a cluster share, for tables that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a local session (one machine, as in tests) takes the
    machine's temporary folder; on a cluster that is an error, because each
    executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "bandscan-shared")
    _MADE.append(f"{base.rstrip('/')}/bandscan-{uuid.uuid4().hex}")
    return _MADE[-1]


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def cleaned(spark: SparkSession) -> None:
    """Deletes all folders of this process; results that have not been written elsewhere are lost."""
    removed(spark, *_MADE)
    _MADE.clear()
