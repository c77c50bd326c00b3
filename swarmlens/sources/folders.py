"""A folder of the session's own that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one, which only a local master can share.

    It is deleted when the session's driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        context = spark.sparkContext
        if context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone; the cluster cleans its folder
        pass


def local_path(folder: str) -> str:
    """The path of a folder on a file system that every machine mounts."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"not a mounted folder: {folder}")
    return folder.removeprefix("file://")
