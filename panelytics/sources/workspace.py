"""Folders for tables written once and read by many queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A fresh path below the cluster's shared ``spark.checkpoint.dir``; it is removed when the session's JVM ends.

    Without that setting: a temporary folder when Spark runs inside this one process, else an error, because a
    machine-local folder would not be visible to all executors.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="panelytics-")
    folder = f"{shared.rstrip('/')}/panelytics-{uuid.uuid4().hex}"
    _remove_at_end(spark, folder)
    return folder


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
