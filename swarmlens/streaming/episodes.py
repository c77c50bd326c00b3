"""Append to a graph's memory from a stream: files of tasks, one commit an epoch, replays that add nothing.

A task writes what it has into a file of its own.  The
driver commits an epoch by one rename of its manifest, which lists the files;
readers see files that a manifest lists, and nothing else.  An epoch that
Spark runs again finds its manifest and throws its new files away.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from swarmlens.sources.folders import local_path


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    rows: int


class _EpisodeWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        path, rows, writer = f"{self.folder}/files/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    writer = pq.ParquetWriter(path, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return _Written(path if rows else None, rows)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        found = [m for m in messages if m is not None and m.path is not None]
        manifest = f"{self.folder}/commits/{batchId}.json"
        if os.path.exists(manifest):  # this epoch has been committed before
            self.abort(found, batchId)
            return
        os.makedirs(os.path.dirname(manifest), exist_ok=True)
        draft = f"{self.folder}/commits/.{batchId}-{uuid.uuid4().hex}"
        with open(draft, "w") as out:
            json.dump({"epoch": batchId, "rows": sum(m.rows for m in found), "files": [os.path.basename(m.path) for m in found]}, out)
            out.flush()
            os.fsync(out.fileno())
        os.rename(draft, manifest)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        for m in messages:
            if m is not None and m.path is not None and os.path.exists(m.path):
                os.remove(m.path)


class EpisodeSink(DataSource):
    """``writeStream.format("episode_memory").option("path", folder)`` on a folder that all machines mount."""

    @classmethod
    def name(cls) -> str:
        return "episode_memory"

    def streamWriter(self, schema, overwrite):
        if overwrite:
            raise ValueError("a graph's memory is appended to only")
        return _EpisodeWriter(local_path(self.options["path"]))


def append_episodes(rows: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start appending streamed ``rows`` to the memory in ``folder``."""
    rows.sparkSession.dataSource.register(EpisodeSink)
    writer = rows.writeStream.format("episode_memory").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, rows, files) of the manifests of a memory."""
    return spark.read.schema("epoch long, rows long, files array<string>").json(f"{folder}/commits/*.json")


def episodes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all committed epochs.

    The files' names travel as a table, so the driver lists none of them itself.
    """
    rows = spark.read.schema(schema).parquet(f"{folder}/files").selectExpr("*", "_metadata.file_name AS _file")
    known = committed(spark, folder).selectExpr("explode(files) AS _file")
    return rows.join(known, "_file", "left_semi").drop("_file")
