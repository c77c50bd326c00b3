"""Rollups that are kept up to date: partial states of every arrival, merged when they are read.

An arrival (a file, an epoch) writes three tables of its own: counts and times
by platform, round and kind with a theta sketch of the agents; the same by
agent; and the different pairs of round and agent.  They are sums, minima,
maxima and unions, so merging the arrivals gives what one pass over all
actions gives, and only new actions are ever read.  An arrival that is added
again takes the place of its first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_BITS = 12  #: 4096 entries: a standard error of about 1.6 % beyond that many agents, and none below
TABLES = ("rounds", "agents", "pairs")


def _times() -> list:
    return [F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")]


def _counts() -> list:
    count = lambda p: F.coalesce(F.sum(F.when(F.col("platform") == p, F.col("n"))), F.lit(0))
    return [count("twitter").alias("twitter_actions"), count("reddit").alias("reddit_actions"), F.sum("n").alias("total_actions")]


def partials(actions: DataFrame) -> dict[str, DataFrame]:
    """The three tables of ``actions`` (seq, platform, agent_id, agent_name, action_type, timestamp, round)."""
    own = [F.count("*").alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")]
    newest = F.max_by("agent_name", F.struct("timestamp", "seq")).alias("agent_name"), F.max(F.struct("timestamp", "seq")).alias("newest")
    return {
        "rounds": actions.groupBy("platform", "round", "action_type").agg(*own, F.theta_sketch_agg("agent_id", SKETCH_BITS).alias("sketch")),
        "agents": actions.groupBy("platform", "agent_id", "action_type").agg(*own, *newest),
        "pairs": actions.select("round", "agent_id").distinct(),
    }


@dataclass(frozen=True)
class Rollup:
    spark: SparkSession
    folder: str

    def add(self, arrival: str, actions: DataFrame) -> None:
        """Write the partial states of an arrival; ``pairs`` go last and mark it as whole."""
        self._save(arrival, partials(actions))

    def _save(self, arrival: str, tables: dict[str, DataFrame]) -> None:
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/arrival={arrival}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def timeline(self, exact: bool = True) -> DataFrame:
        """One row per round: counts by platform, different agents (estimated from sketches where not exact), first and last time."""
        rounds = self.table("rounds")
        agents = F.theta_sketch_estimate(F.theta_union_agg("sketch", SKETCH_BITS)).cast("long").alias("active_agents")
        merged = rounds.groupBy("round").agg(*_counts(), *_times(), *([] if exact else [agents]))
        if exact:
            different = self.table("pairs").groupBy("round").agg(F.count_distinct("agent_id").alias("active_agents"))
            merged = merged.join(different, "round")
        return merged.select("round", "twitter_actions", "reddit_actions", "total_actions", "active_agents", "first_time", "last_time")

    def action_types(self) -> DataFrame:
        """(round, action_type, n)."""
        return self.table("rounds").groupBy("round", "action_type").agg(F.sum("n").alias("n"))

    def agent_stats(self) -> DataFrame:
        """One row per agent; the name is that of the newest action."""
        return self.table("agents").groupBy("agent_id").agg(F.max_by("agent_name", "newest").alias("agent_name"), *_counts(), *_times())

    def merged(self, folder: str, arrival: str = "merged") -> Rollup:
        """All arrivals as one, in another folder."""
        rounds, agents = self.table("rounds"), self.table("agents")
        n = F.sum("n").alias("n")
        tables = {
            "rounds": rounds.groupBy("platform", "round", "action_type").agg(n, *_times(), F.theta_union_agg("sketch", SKETCH_BITS).alias("sketch")),
            "agents": agents.groupBy("platform", "agent_id", "action_type").agg(n, *_times(), F.max_by("agent_name", "newest").alias("agent_name"), F.max("newest").alias("newest")),
            "pairs": self.table("pairs").select("round", "agent_id").distinct(),
        }
        other = Rollup(self.spark, folder)
        other._save(arrival, tables)
        return other
