"""Action streams: a tail of growing logs, running state, batches by count, windows and dedupe."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = "file string, value string"


class _Part(InputPartition):
    """Lines of a file that begin at ``low`` or later and before ``high``; ``first`` is where a line is known to begin."""

    def __init__(self, path: str, first: int, low: int, high: int):
        self.path, self.first, self.low, self.high = path, first, low, high


class _TailReader(DataSourceStreamReader):
    """Offsets are bytes of each file that whole lines end at, so a torn last line waits.

    The driver looks at the ends of files only; executors read parts of
    bounded size.
    """

    PART_BYTES = 8 << 20

    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.endswith((".jsonl", ".json", ".txt")) and n[0] not in "._")

    def latestOffset(self) -> dict:
        return {path: end for path in self._files() if (end := self._whole(path))}

    @staticmethod
    def _whole(path: str, step: int = 1 << 16) -> int:
        """The place after the last line end."""
        with open(path, "rb") as log:
            at = log.seek(0, os.SEEK_END)
            while at:
                low = max(0, at - step)
                log.seek(low)
                found = log.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            parts += [_Part(path, first, low, min(stop, low + self.PART_BYTES)) for low in range(first, stop, self.PART_BYTES)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as log:
            if partition.low > partition.first:  # the line that goes on here is the part's before
                log.seek(partition.low - 1)
                log.readline()
            else:
                log.seek(partition.low)
            while log.tell() < partition.high:
                line = log.readline().rstrip(b"\r\n")
                if line.strip():
                    yield partition.path, line.decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").option("path", folder)``: new lines of every *.jsonl, *.json and *.txt below a folder."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return LOG_SCHEMA

    def streamReader(self, schema):
        return _TailReader(dict(self.options))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("jsonl_tail").option("path", folder).load()


def parsed(lines: DataFrame) -> DataFrame:
    """Actions and control events of log lines; unreadable lines are left out."""
    row = F.from_json("value", "round INT, timestamp TIMESTAMP_NTZ, agent_id BIGINT, agent_name STRING, action_type STRING, event_type STRING, platform STRING")
    rows = lines.select("file", row.alias("r")).where("r is not null").select("file", "r.*")
    folder = F.regexp_extract("file", r"([^/=]+)/[^/]*$", 1)
    rows = rows.withColumn("platform", F.coalesce(F.nullif("platform", F.lit("")), folder)).drop("file")
    return rows.where("event_type is not null or agent_id is not null")


STATE = "platform string, actions long, current_round int, completed boolean, recent string"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts, latest round, completion and the newest 50 actions of a platform."""
    count, latest, done, recent = state.get if state.exists else (0, 0, False, "[]")
    newest = json.loads(recent)
    for frame in frames:
        rounds = frame["round"].dropna()
        latest = max(latest, int(rounds.max()) if len(rounds) else 0)
        done = bool(done or (frame["event_type"] == "simulation_end").any())
        acts = frame[frame["event_type"].isna()]
        count += len(acts)
        newest += [[str(t), int(a), k] for t, a, k in zip(acts["timestamp"], acts["agent_id"], acts["action_type"])]
    newest = sorted(newest, reverse=True)[:50]
    state.update((count, latest, done, json.dumps(newest)))
    yield pd.DataFrame({"platform": [key[0]], "actions": [count], "current_round": [latest], "completed": [done], "recent": [json.dumps(newest)]})


def run_state(rows: DataFrame) -> DataFrame:
    """Running state by platform, a new row whenever a platform has news."""
    return rows.groupBy("platform").applyInPandasWithState(_fold, STATE, "actions long, current_round int, completed boolean, recent string", "update", GroupStateTimeout.NoTimeout)


def count_batches(rows: DataFrame, size: int = 5) -> DataFrame:
    """(platform, batch, n, text) for every ``size`` rows (platform, text) of a platform, and the rest when it ends.

    A row with a null text is the end of its platform's input.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, "[]")
        waiting = json.loads(held)
        ended = False

        def batches(last: bool) -> pd.DataFrame:
            """What is whole of what waits, in one pass; with ``last`` the rest too."""
            nonlocal number, waiting
            stop = len(waiting) if last else len(waiting) // size * size
            parts = [waiting[k : min(k + size, stop)] for k in range(0, stop, size)]
            waiting, first, number = waiting[stop:], number, number + len(parts)
            return pd.DataFrame([(key[0], first + k, len(p), "\n".join(p)) for k, p in enumerate(parts)], columns=["platform", "batch", "n", "text"])

        for frame in frames:
            told = frame["text"].notna()
            ended |= bool((~told).any())
            waiting += frame["text"][told].tolist()
            yield batches(False)
        if ended and waiting:
            yield batches(True)
        state.update((number, json.dumps(waiting)))

    return rows.groupBy("platform").applyInPandasWithState(run, "platform string, batch long, n long, text string", "batch long, held string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows without repeats of (timestamp, platform, agent_id, action_type) within the delay."""
    timed = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["timestamp", "platform", "agent_id", "action_type"])


def windowed(rows: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts in event-time windows; late rows past the delay are left out."""
    timed = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width), "platform").agg(F.count("*").alias("n"))


def finished(queries: dict[str, StreamingQuery], seconds: float = 600.0) -> dict[str, bool]:
    """Which of the named queries, one for each simulation, end within the time all have together; the others go on."""
    stop = time.monotonic() + seconds
    return {name: bool(q.awaitTermination(max(0.001, stop - time.monotonic()))) for name, q in queries.items()}
