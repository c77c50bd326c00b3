"""Sinks: action logs, profiles, run state, sections."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmlens.functions import rules
from swarmlens.operators import ranges

# What a profile has where nothing is known.
DEFAULTS = {"karma": 1000, "age": 30, "mbti": "ISTJ", "country": "中国"}
BIO_LENGTH = 150


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]", " ")


def reddit_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with defaults filled, the bio cut and the gender in one of three spellings."""
    filled = {k: F.coalesce(F.nullif(F.col(k), F.lit(0 if isinstance(v, int) else "")), F.lit(v)) for k, v in DEFAULTS.items()}
    columns = filled | {"username": F.col("user_name"), "bio": F.left("bio", F.lit(BIO_LENGTH)), "gender": rules.gender("gender")}
    return profiles.withColumns(columns)


def twitter_profiles(profiles: DataFrame) -> DataFrame:
    """(user_id, name, username, user_char, description); user_id is the place by id from 0.

    A total order over profiles is what the format asks for; places come from
    ranges, so no task sorts all rows.
    """
    ordered = ranges.numbered(profiles, "user_id")
    char = F.when(F.coalesce("persona", F.lit("")).isin("") | (F.col("persona") == F.col("bio")), F.col("bio")).otherwise(F.concat_ws(" ", "bio", "persona"))
    return ordered.select(F.col("place").alias("user_id"), "name", F.col("user_name").alias("username"), _flat(char).alias("user_char"), _flat(F.col("bio")).alias("description"))


def write_reddit(profiles: DataFrame, path: str) -> None:
    reddit_profiles(profiles).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_twitter(profiles: DataFrame, path: str) -> None:
    twitter_profiles(profiles).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_actions(actions: DataFrame, path: str) -> None:
    """Action records as JSON lines, a folder for each platform."""
    actions.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").partitionBy("platform").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Control records (event_type and its fields) as JSON lines."""
    events.write.mode("append").json(path)


def append_report_log(log: DataFrame, path: str) -> None:
    """Records of a report's making (report_id, line, action, section_index, elapsed, details as JSON text), a JSON object a line."""
    details = F.from_json("details", "map<string, string>").alias("details")
    log.select("report_id", "line", "action", "section_index", F.col("elapsed").alias("elapsed_seconds"), details).write.mode("append").json(path)


def append_progress(progress: DataFrame, path: str) -> None:
    """Progress records (report_id, line, status, progress, message, current_section); the last of a report is its state."""
    progress.select("report_id", "line", "status", "progress", "message", "current_section").write.mode("append").json(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """(section_index, title, body) as one text file each, named by index."""
    lines = sections.select(F.format_string("section_%02d", "section_index").alias("section"), F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("value"))
    lines.write.mode("overwrite").partitionBy("section").text(path)


def assembled_report(title: str, summary: str, sections: DataFrame) -> DataFrame:
    """One row: the whole report, sections in order."""
    parts = sections.agg(F.array_sort(F.collect_list(F.struct("section_index", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("text")))).alias("s"))
    return parts.select(F.concat(F.lit(f"# {title}\n\n> {summary}\n\n---\n\n"), F.array_join(F.col("s.text"), "\n\n")).alias("report"))


# Files that a run of a simulation leaves in its folder.
RUN_FILES = ("run_state.json", "simulation.log", "stdout.log", "stderr.log", "twitter_simulation.db", "reddit_simulation.db", "env_status.json", "twitter/actions.jsonl", "reddit/actions.jsonl")


def cleaned_run(folder: str) -> list[tuple[str, str]]:
    """(file, error) of the run files of a folder that were there: deleted ones have no error."""
    out = []
    for name in RUN_FILES:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            try:
                os.remove(path)
                out.append((name, ""))
            except OSError as e:
                out.append((name, str(e)))
    return out


def saved_file(folder: str, name: str, data: bytes) -> dict:
    """Save an uploaded file under eight random hex digits and its own extension."""
    os.makedirs(folder, exist_ok=True)
    saved = uuid.uuid4().hex[:8] + os.path.splitext(name)[1].lower()
    with open(os.path.join(folder, saved), "wb") as out:
        out.write(data)
    return {"original": name, "saved": saved, "size": len(data)}
