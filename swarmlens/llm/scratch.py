"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="swarmlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    ``keep`` writes a frame as Parquet and reads it back, which cuts its
    lineage; ``drop`` deletes what is no longer read.  What a lazy result still
    reads stays until the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._kept: list[str] = []
        self._swept = time.monotonic()
        atexit.register(self._close)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.base}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self._kept.append(path)
        self.sweep()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for folder in {os.path.dirname(f) for f in df.inputFiles()}:
                if urlsplit(folder).path.startswith(urlsplit(self.base).path + "/"):  # the setting may lack the scheme
                    self._delete(folder)

    def leave(self, *frames: DataFrame) -> None:
        """Delete all tables kept here but ``frames``, when nothing else is read any more."""
        still = {os.path.basename(os.path.dirname(f)) for df in frames for f in df.inputFiles()}
        gone = [p for p in self._kept if os.path.basename(p) not in still]
        self._kept = [p for p in self._kept if os.path.basename(p) in still]
        for path in gone:
            self._delete(path)

    def sweep(self) -> None:
        """Let the shuffle files of finished steps go: Spark deletes them once the driver forgets their plans.

        Listeners hold on to the last execution they heard of, so they get a
        small one.  Steps of less than a second leave too little behind for that.
        """
        if time.monotonic() - self._swept < 1:
            return
        self._swept = time.monotonic()
        self.spark.range(1).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)
        except Exception:  # the session is already gone; the cluster cleans its folder
            pass
