"""A clustered store of actions: newest first in slices, with what lets a reader skip files.

Actions are cut into ranges of their order (time, newest first, then platform
and arrival), a file each.  Beside them stand two small tables: ``slices`` has
what each file holds of each platform and its range of rounds and times, and
``agents`` which files hold an agent, by agent.  A history reads the files of
its agent and rounds only, where Parquet's own statistics and a Bloom filter
on agent_id rule out row groups; a page at any depth reads the files that its
ranks fall into, and sorts these alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmlens.operators import actions as ops

ROWS = 100_000  #: of a slice, in the mean


def _order() -> list:
    return [F.desc("timestamp"), F.desc("platform"), F.asc("seq")]


@dataclass(frozen=True)
class ActionStore:
    spark: SparkSession
    folder: str

    def actions(self, files: list[str] | None = None) -> DataFrame:
        """The actions of all files, or of those named."""
        every = self.spark.read.parquet(f"{self.folder}/actions")
        if files is None:
            return every.drop("slice")
        return (self.spark.read.schema(every.schema).parquet(*files) if files else every.limit(0)).drop("slice")

    def slices(self) -> DataFrame:
        """(slice, file, platform, n, first_round, last_round, first_time, last_time)."""
        return self.spark.read.parquet(f"{self.folder}/slices")

    def agents(self) -> DataFrame:
        """(agent_id, platform, slice, file, n)."""
        return self.spark.read.parquet(f"{self.folder}/agents")

    def files(self, platform: str | None = None, agent_id: int | None = None, rounds: tuple[int, int] | None = None) -> list[str]:
        """Those that may hold an action of the platform, agent and rounds."""
        found = self.slices()
        if platform is not None:
            found = found.where(F.col("platform") == platform)
        if rounds is not None:
            found = found.where((F.col("last_round") >= rounds[0]) & (F.col("first_round") <= rounds[1]))
        if agent_id is not None:
            held = self.agents().where(F.col("agent_id") == agent_id)
            found = found.join(held, ["file", "platform"], "left_semi")
        return sorted(r["file"] for r in found.select("file").distinct().collect())  # a name a file, as Spark's own listing

    def history(self, platform: str | None = None, agent_id: int | None = None, rounds: tuple[int, int] | None = None) -> DataFrame:
        """All actions of a platform, an agent and a range of rounds (both ends included); each may be left open."""
        rows = ops.history(self.actions(self.files(platform, agent_id, rounds)), platform, agent_id)
        return rows if rounds is None else rows.where(F.col("round").between(*rounds))

    def page(self, limit: int = 100, offset: int = 0, platform: str | None = None) -> DataFrame:
        """Actions ``offset`` to ``offset + limit`` of the newest first, of one platform or all."""
        slices = self.slices()
        if platform is not None:
            slices = slices.where(F.col("platform") == platform)
        # a row a file: counts that lead to the slices of the page
        counts = slices.groupBy("slice", "file").agg(F.sum("n").alias("n"))
        placed = counts.withColumn("before", F.sum("n").over(Window.orderBy("slice")) - F.col("n"))
        held = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("slice").collect()
        rows = ops.history(self.actions([r["file"] for r in held]), platform)
        return ops.page(rows, limit, offset - held[0]["before"] if held else 0)


def write(actions: DataFrame, folder: str, rows: int = ROWS) -> ActionStore:
    """Store ``actions`` (seq, platform, agent_id, timestamp, round, ...) in a new folder."""
    store = ActionStore(actions.sparkSession, folder)
    parts = max(1, math.ceil(actions.count() / rows))
    sliced = actions.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).withColumn("slice", F.spark_partition_id())
    writer = sliced.write.option("parquet.bloom.filter.enabled#agent_id", "true").option("parquet.bloom.filter.expected.ndv#agent_id", str(rows))
    writer.parquet(f"{folder}/actions")
    held = store.spark.read.parquet(f"{folder}/actions").select("slice", F.col("_metadata.file_path").alias("file"), "platform", "agent_id", "round", "timestamp")
    span = [f(c).alias(f"{name}_{what}") for what, c in (("round", "round"), ("time", "timestamp")) for name, f in (("first", F.min), ("last", F.max))]
    held.groupBy("slice", "file", "platform").agg(F.count("*").alias("n"), *span).coalesce(1).write.parquet(f"{folder}/slices")
    agents = held.groupBy("agent_id", "platform", "slice", "file").agg(F.count("*").alias("n"))
    agents.repartitionByRange("agent_id", "slice").sortWithinPartitions("agent_id", "slice").write.parquet(f"{folder}/agents")
    return store
