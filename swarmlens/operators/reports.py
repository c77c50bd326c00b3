"""Operators over report logs, states, ontologies and tasks.

A report log has rows (report_id, line, action, section_index, elapsed,
details), details being JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Actions of a report log.
TOOL_CALL, SECTION_DONE, REPORT_DONE, PLANNED = "tool_call", "section_complete", "report_complete", "planning_complete"

# Files of a prepared simulation, and states it may be in.
PREPARED_FILES = ("state.json", "simulation_config.json", "reddit_profiles.json", "twitter_profiles.csv")
PREPARED_STATES = ("ready", "preparing", "running", "completed", "stopped", "failed")

# Limits of an ontology.
MOST_TYPES, DESCRIPTION_LENGTH = 10, 100
FALLBACK_TYPES = ("Person", "Organization")


def log_summary(log: DataFrame) -> DataFrame:
    """One row per report: tool calls, sections done, whether it is planned and complete, time of the last line."""
    return log.groupBy("report_id").agg(
        F.count_if(F.col("action") == TOOL_CALL).alias("tool_calls"),
        F.count_distinct(F.when(F.col("action") == SECTION_DONE, F.col("section_index"))).alias("sections_done"),
        F.bool_or(F.col("action") == PLANNED).alias("planned"),
        F.bool_or(F.col("action") == REPORT_DONE).alias("complete"),
        F.max_by("elapsed", "line").alias("elapsed"),
    )


def section_progress(done: Column, sections: Column) -> Column:
    """Percent of sections done, 0 without sections."""
    return F.when(sections > 0, F.round(100 * done / sections).cast("int")).otherwise(0)


def step_status(summary: DataFrame) -> DataFrame:
    """(report_id, step, status): planning, writing and completion, each done, active or todo."""
    writing = F.when(F.col("complete"), "done").when(F.col("planned"), "active").otherwise("todo")
    steps = F.array(
        F.struct(F.lit("planning").alias("step"), F.when(F.col("planned"), "done").otherwise("active").alias("status")),
        F.struct(F.lit("writing").alias("step"), writing.alias("status")),
        F.struct(F.lit("complete").alias("step"), F.when(F.col("complete"), "done").otherwise("todo").alias("status")),
    )
    return summary.select("report_id", F.inline(steps))


def last_sections(log: DataFrame) -> DataFrame:
    """(report_id, section_index, content): the last content of each section."""
    rows = log.where(F.col("action") == SECTION_DONE)
    return rows.groupBy("report_id", "section_index").agg(F.max_by(F.get_json_object("details", "$.content"), "line").alias("content"))


def run_states(raw: DataFrame) -> DataFrame:
    """Run states from JSON text, with defaults for what is missing."""
    schema = "simulation_id STRING, runner_status STRING, current_round INT, total_rounds INT, twitter_actions_count BIGINT, reddit_actions_count BIGINT, recent_actions ARRAY<STRUCT<agent_id: BIGINT, action_type: STRING>>"
    row = raw.select(F.from_json("value", schema).alias("r")).where("r.simulation_id is not null").select("r.*")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("current_round", "total_rounds", "twitter_actions_count", "reddit_actions_count")}
    empty = F.array().cast("array<struct<agent_id: bigint, action_type: string>>")
    return row.withColumns(zero | {"runner_status": F.coalesce("runner_status", F.lit("idle")), "recent_actions": F.coalesce("recent_actions", empty)})


def missing_files(present: Column, required: tuple[str, ...] = PREPARED_FILES) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def is_prepared(present: Column, status: Column, config_generated: Column) -> Column:
    return (F.size(missing_files(present)) == 0) & status.isin(*PREPARED_STATES) & config_generated


def both_platforms(rows: DataFrame) -> DataFrame:
    """Rows without a platform once for each."""
    every = F.when(F.col("platform").isNull(), F.array(F.lit("twitter"), F.lit("reddit"))).otherwise(F.array("platform"))
    return rows.withColumn("platform", F.explode(every))


def new_facts(found: Column, known: Column, most: int = 15) -> Column:
    return F.slice(F.array_except(found, known), 1, most)


def unused_tools(used: Column, tools: tuple[str, ...]) -> Column:
    return F.array_except(F.array(*map(F.lit, tools)), used)


def client_key(timestamp: Column, platform: Column, agent_id: Column, action: Column) -> Column:
    return F.concat_ws("-", timestamp.cast("string"), platform, agent_id.cast("string"), action)


def with_fallback_types(types: Column) -> Column:
    """Entity types cut to the limit so that both fallback types have a place, with short descriptions.

    ``types`` is an array of structs (name, description).
    """
    short = F.transform(types, lambda t: F.struct(t["name"].alias("name"), F.when(F.length(t["description"]) > DESCRIPTION_LENGTH, F.concat(F.left(t["description"], F.lit(DESCRIPTION_LENGTH - 3)), F.lit("..."))).otherwise(t["description"]).alias("description")))
    names = F.transform(types, lambda t: t["name"])
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f"Any {n.lower()} of no other type").alias("description")) for n in FALLBACK_TYPES))
    added = F.filter(wanted, lambda t: ~F.array_contains(names, t["name"]))
    return F.concat(F.slice(short, F.lit(1), F.greatest(F.lit(0), F.lit(MOST_TYPES) - F.size(added))), added)


def valid_edge_types(edge_types: DataFrame) -> DataFrame:
    """Edge types (name, source_targets) that have endpoints, at most ten by name."""
    return edge_types.where(F.size("source_targets") > 0).orderBy("name").limit(MOST_TYPES)


def aged(tasks: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Finished tasks older than so many hours."""
    return tasks.where(F.col("status").isin("completed", "failed") & (F.col("created_at") < now - F.make_dt_interval(hours=F.lit(hours))))


def newest_tasks(tasks: DataFrame, task_type: str | None = None) -> DataFrame:
    rows = tasks if task_type is None else tasks.where(F.col("task_type") == task_type)
    return rows.orderBy(F.desc("created_at"), "task_id")


def topic_total(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.sum(F.coalesce(F.size("interested_topics"), F.lit(0))).alias("topics"))


def snapshot(profiles: DataFrame, simulations: DataFrame) -> DataFrame:
    """(simulation_id, n_profiles, expected, generating) of simulations, whether or not they have profiles yet."""
    done = profiles.groupBy("simulation_id").agg(F.count("*").alias("n_profiles"))
    rows = simulations.join(done, "simulation_id", "left")
    return rows.select("simulation_id", F.coalesce("n_profiles", F.lit(0)).alias("n_profiles"), "expected", (F.col("status") == "preparing").alias("generating"))


def recent_ring(actions: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The newest ``n`` actions of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("timestamp"), F.desc("seq")))
    return actions.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
