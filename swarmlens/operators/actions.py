"""Operators over agent actions (platform, agent_id, action_type, timestamp, round, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.operators import ranges

IDLE = "DO_NOTHING"


def history(actions: DataFrame, platform: str | None = None, agent_id: int | None = None, round: int | None = None) -> DataFrame:
    """Rows that meet all given conditions; unordered, so the filters reach the scan."""
    for name, value in (("platform", platform), ("agent_id", agent_id), ("round", round)):
        if value is not None:
            actions = actions.where(F.col(name) == value)
    return actions


def newest_first(actions: DataFrame) -> DataFrame:
    """By time, newest first; ties by platform (twitter before reddit) and arrival."""
    return actions.orderBy(F.desc("timestamp"), F.desc("platform"), "seq")


def page(actions: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return newest_first(actions).offset(offset).limit(limit)


def without_idle(actions: DataFrame, idle: str = IDLE) -> DataFrame:
    return actions.where(F.col("action_type") != idle)


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("platform") == "twitter").alias("twitter_actions"),
        F.count_if(F.col("platform") == "reddit").alias("reddit_actions"),
        F.count("*").alias("total_actions"),
    ]


def timeline(actions: DataFrame, start: int = 0, end: int | None = None, compat: bool = False) -> DataFrame:
    """One row per round: counts by platform, different agents, first and last time.

    ``compat`` swaps first and last time, as an input sorted newest first does.
    """
    rows = actions.where(F.col("round") >= start)
    if end is not None:
        rows = rows.where(F.col("round") <= end)
    first, last = F.min("timestamp"), F.max("timestamp")
    if compat:
        first, last = last, first
    return rows.groupBy("round").agg(*_counts(), F.count_distinct("agent_id").alias("active_agents"), first.alias("first_action_time"), last.alias("last_action_time"))


def histogram(actions: DataFrame, *keys: str) -> DataFrame:
    """Long form of the action-type counts by ``keys``."""
    return actions.groupBy(*keys, "action_type").agg(F.count("*").alias("n"))


def histogram_maps(actions: DataFrame, *keys: str) -> DataFrame:
    """The counts as one map per key; types are few, so the map is bounded."""
    counts = histogram(actions, *keys)
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action_type", "n")))).alias("action_types"))


def agent_stats(actions: DataFrame) -> DataFrame:
    """One row per agent; the name is that of the newest action."""
    return actions.groupBy("agent_id").agg(
        F.max_by("agent_name", F.struct("timestamp", "seq")).alias("agent_name"),
        *_counts(),
        F.min("timestamp").alias("first_action_time"),
        F.max("timestamp").alias("last_action_time"),
    )


def progress(actions: DataFrame, total_rounds: int, minutes_per_round: int = 60) -> DataFrame:
    """One row of run state: current round, counts, simulated hours and percent (half-even, 1 digit)."""
    state = actions.agg(F.coalesce(F.max("round"), F.lit(0)).alias("current_round"), *_counts())
    percent = F.bround(F.col("current_round") / F.lit(max(total_rounds, 1)) * 100, 1)
    return state.withColumns({"progress_percent": percent, "simulated_hours": F.floor(F.col("current_round") * minutes_per_round / 60)})


def recent(actions: DataFrame, n: int = 50) -> DataFrame:
    return newest_first(actions).limit(n)


def round_changes(actions: DataFrame) -> DataFrame:
    """The first action of every round on a platform, with the round before it."""
    # partial aggregation first: the window then sees one row per platform and round
    first = actions.groupBy("platform", "round").agg(F.min(F.struct("timestamp", "seq")).alias("first"))
    before = F.lag("round").over(Window.partitionBy("platform").orderBy("round"))
    return first.select("platform", "round", before.alias("previous_round"), "first.timestamp", "first.seq")


def deduplicated(actions: DataFrame) -> DataFrame:
    """One action per (second, platform, agent, type), the first to arrive."""
    key = [F.date_trunc("second", "timestamp").alias("second"), "platform", "agent_id", "action_type"]
    return actions.groupBy(*key).agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))


def arrival_batches(actions: DataFrame, size: int = 5) -> DataFrame:
    """Batch number (from 0) and place of every action in its platform's order of arrival (``seq``)."""
    place = F.col("place")
    return ranges.numbered(actions, "seq", "platform").select(*actions.columns, F.floor(place / size).alias("batch"), (place % size).alias("slot"))


def batch_texts(batched: DataFrame) -> DataFrame:
    """The texts of each batch in order, one line each."""
    rows = batched.groupBy("platform", "batch").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("t"))
    return rows.select("platform", "batch", F.size("t").alias("n"), F.array_join(F.col("t.text"), "\n").alias("text"))


def update_stats(batched: DataFrame, size: int = 5) -> DataFrame:
    """What a memory updater counts of each platform: activities, batches, full ones, and what waits for a full one."""
    sizes = batched.groupBy("platform", "batch").agg(F.count("*").alias("n"))
    return sizes.groupBy("platform").agg(
        F.sum("n").alias("activities"),
        F.count("*").alias("batches"),
        F.count_if(F.col("n") == size).alias("full_batches"),
        F.coalesce(F.sum(F.when(F.col("n") < size, F.col("n"))), F.lit(0)).alias("waiting"),
    )


def completion(ends: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: whether every platform with a log has ended, and at least one has a log."""
    state = logs.select("platform").distinct().join(ends.select("platform", F.lit(True).alias("ended")).distinct(), "platform", "left")
    return state.agg(F.count("*").alias("platforms"), (F.coalesce(F.bool_and(F.coalesce("ended", F.lit(False))), F.lit(False))).alias("all_completed"))


def tumbling(actions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and values in event-time windows; the same plan runs on a stream."""
    return actions.groupBy(F.window(F.col("timestamp"), width), "platform").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
