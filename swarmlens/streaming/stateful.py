"""Stateful streams with timers: batches that wait, newest actions and progress of every platform of every simulation.

Timers run in epochs of their own, so a query goes on after its input has
ended, until it is stopped.  With spark.sql.streaming.noDataMicroBatches.enabled
off, timers wait for the next rows and ``availableNow`` ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ("platform", "simulation")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = 4096  #: batches that a task gives out at once
BATCH, RECENT = 5, 50  #: fixed values: actions of a batch, and newest actions shown

BATCHES = "platform string, simulation string, batch long, n long, reason string, text string"
NEWEST = "platform string, simulation string, place int, seq long, text string"


def _with_state(rows: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # state with timers needs it
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="processingTime")


class _Batcher(StatefulProcessor):
    """State of a key: the rows that wait, the number of the next batch and when the timer is due."""

    def __init__(self, size: int, idle_ms: int, keep_ms: int):
        self.size, self.idle_ms, self.keep_ms = size, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, text string", self.keep_ms)
        self.progress = handle.getValueState("progress", "batch long, due long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, due = (self.progress.get() if self.progress.exists() else None) or (0, -1)
        held = [(int(s), t) for s, t in self.waiting.get()] if self.waiting.exists() else []
        ended = False
        frames = [pd.DataFrame(held, columns=["seq", "text"]).astype({"seq": "int64", "text": "object"})]
        for frame in rows:
            told = frame["text"].notna()
            ended |= bool((~told).any())
            frames.append(frame.loc[told, ["seq", "text"]])
        came = pd.concat(frames, ignore_index=True).sort_values(["seq", "text"])
        del frames
        stop = len(came) if ended else len(came) // self.size * self.size
        held = [(int(s), t) for s, t in zip(came["seq"].iloc[stop:], came["text"].iloc[stop:])]
        text = came["text"].to_numpy()[:stop]
        for low in range(0, stop, self.size * FRAME):
            parts = [text[k : k + self.size] for k in range(low, min(stop, low + self.size * FRAME), self.size)]
            yield self._frame([(*key, number + k, len(p), "full" if len(p) == self.size else "end", "\n".join(p)) for k, p in enumerate(parts)])
            number += len(parts)
        if due >= 0:
            self.handle.deleteTimer(due)
            due = -1
        if held:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
            self.waiting.put(held)
        else:
            self.waiting.clear()
        self.progress.update((number, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, due = (self.progress.get() if self.progress.exists() else None) or (0, -1)
        out = []
        if due == expiredTimerInfo.getExpiryTimeInMs() and self.waiting.exists():
            held = sorted((int(s), t) for s, t in self.waiting.get())
            out.append(self._batch(key, number, held, "idle"))
            self.waiting.clear()
            self.progress.update((number + 1, -1))
        yield self._frame(out)

    @staticmethod
    def _batch(key, number: int, part: list, reason: str) -> tuple:
        return (*key, number, len(part), reason, "\n".join(t for _, t in part))

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["platform", "simulation", "batch", "n", "reason", "text"]).astype({"batch": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def timed_batches(rows: DataFrame, size: int = BATCH, idle_ms: int = 30_000, keep_ms: int = 86_400_000) -> DataFrame:
    """(platform, simulation, batch, n, reason, text) of streamed ``rows`` (platform, simulation, seq, text).

    A batch is ``size`` rows of a platform of a simulation, or what waits when
    a row with a null text ends its input, or when no row has come for
    ``idle_ms``.  Rows that come together are put in the order of seq; one that
    comes late is in a later batch.  State of keys that are silent for
    ``keep_ms`` expires, and their numbers begin again.
    """
    wanted = rows.select(*KEYS, F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
    return _with_state(wanted, _Batcher(size, idle_ms, keep_ms), BATCHES, "append")


class _Newest(StatefulProcessor):
    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", "seq long, text string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(int(s), t) for s, t in self.newest.get()} if self.newest.exists() else set()
        for frame in rows:
            frame = frame[frame["text"].notna()].nlargest(self.most, "seq", keep="all")
            held |= {(int(s), t) for s, t in zip(frame["seq"], frame["text"])}
            held = set(sorted(held, reverse=True)[: self.most])
        if held:
            kept = sorted(held, reverse=True)
            self.newest.put(kept)
            yield pd.DataFrame([(*key, place, s, t) for place, (s, t) in enumerate(kept)], columns=["platform", "simulation", "place", "seq", "text"]).astype({"place": "int32", "seq": "int64"})

    def close(self) -> None:
        pass


def newest_actions(rows: DataFrame, most: int = RECENT, keep_ms: int = 86_400_000) -> DataFrame:
    """(platform, simulation, place, seq, text): the newest ``most`` actions of every key that has news, from place 0."""
    wanted = rows.select(*KEYS, F.col("seq").cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
    return _with_state(wanted, _Newest(most, keep_ms), NEWEST, "update")


def progress(rows: DataFrame) -> DataFrame:
    """(platform, simulation, actions, current_round, completed) of streamed actions and control events, by built-in aggregates.

    ``rows`` has platform, simulation, event_type (null for an action) and round.
    """
    return rows.groupBy(*KEYS).agg(
        F.count_if(F.col("event_type").isNull()).alias("actions"),
        F.coalesce(F.max("round"), F.lit(0)).cast("int").alias("current_round"),
        F.coalesce(F.bool_or(F.col("event_type") == "simulation_end"), F.lit(False)).alias("completed"),
    )
