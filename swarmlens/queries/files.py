"""Round trips: what a sink wrote, or a platform leaves behind, read back by the readers and streams."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens import sinks
from swarmlens.operators import reports
from swarmlens.operators import simulation as ops
from swarmlens.queries.simulation import G, I, _profiles
from swarmlens.sources import model, readers
from swarmlens.sources.folders import local_path, work_folder
from swarmlens.streaming import actions as streams
from swarmlens.streaming import episodes, stateful

A = "WITH " + model.ACTIONS_SQL
#: Platform actions that the events of the test tables stand for; sign-ups are not logged.
TRACE = {"click": "like_post", "view": "search_posts", "purchase": "create_post", "signup": "sign_up", "error": "wave"}
TRACE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRACE.items()) + " END"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


def _named(pairs: dict, column: str):
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.col(column))


# Action logs


def _records(s, d) -> DataFrame:
    return model.actions(s, d).select(
        "platform", F.col("round").cast("int").alias("round"), "timestamp", "agent_id", "agent_name", "action_type",
        F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("k"), F.col("k").cast("string")).alias("action_args"), F.lit("ok").alias("result"), (F.col("value") > 100).alias("success"),
    )


def _action_log(s, d) -> DataFrame:
    folder = work_folder(s, "actions")
    records = _records(s, d)
    sinks.append_actions(records.where("round % 2 = 0"), folder)
    sinks.append_actions(records.where("round % 2 = 1"), folder)  # a log grows
    # control records and torn lines stand in the same logs
    sinks.append_events(s.range(3).select(F.lit("round_end").alias("event_type"), F.col("id").cast("int").alias("round")), f"{folder}/platform=twitter")
    rows = readers.action_log(s, f"{folder}/platform=*")
    return rows.select(F.col("action_args")["seq"].cast("long").alias("seq"), F.replace("platform", F.lit("platform="), F.lit("")).alias("platform"), "agent_id", "action_type", "round", "timestamp", "success")


def _control_log(s, d) -> DataFrame:
    folder = work_folder(s, "events")
    rounds = model.actions(s, d).groupBy("platform", "round").agg(F.count("*").alias("actions_count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    hour, stamp = (F.col("round") % 24).cast("int").alias("simulated_hour"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    whole = rounds.groupBy("platform").agg(F.count("*").alias("total_rounds"), F.sum("actions_count").alias("total_actions"), F.min("first").alias("first"), F.max("last").alias("last"))
    for part in (
        rounds.select(F.lit("round_start").alias("event_type"), "platform", "round", stamp("first"), hour),
        rounds.select(F.lit("round_end").alias("event_type"), "platform", "round", stamp("last"), hour, "actions_count"),
        whole.select(F.lit("simulation_start").alias("event_type"), "platform", stamp("first"), "total_rounds"),
        whole.select(F.lit("simulation_end").alias("event_type"), "platform", stamp("last"), "total_rounds", "total_actions"),
        whole.select(F.lit("legacy_end").alias("event_type"), stamp("last"), "total_actions"),  # a logger of one file names no platform
    ):
        sinks.append_events(part, folder)
    return readers.control_events(s, folder)


CONTROL_SQL = f"""{A}, r AS (SELECT platform, round, count(*) AS n, min("timestamp") AS first, max("timestamp") AS last FROM actions GROUP BY ALL),
  w AS (SELECT platform, count(*) AS rounds, sum(n) AS n, min(first) AS first, max(last) AS last FROM r GROUP BY platform)
SELECT 'round_start' AS event_type, CAST(round AS INTEGER) AS round, strftime(first, '%Y-%m-%dT%H:%M:%S') AS "timestamp", CAST(round % 24 AS INTEGER) AS simulated_hour, CAST(NULL AS INTEGER) AS actions_count, CAST(NULL AS INTEGER) AS total_rounds, CAST(NULL AS INTEGER) AS total_actions, platform FROM r
UNION ALL SELECT 'round_end', round, strftime(last, '%Y-%m-%dT%H:%M:%S'), round % 24, n, NULL, NULL, platform FROM r
UNION ALL SELECT 'simulation_start', NULL, strftime(first, '%Y-%m-%dT%H:%M:%S'), NULL, NULL, rounds, NULL, platform FROM w
UNION ALL SELECT 'simulation_end', NULL, strftime(last, '%Y-%m-%dT%H:%M:%S'), NULL, NULL, rounds, n, platform FROM w
UNION ALL SELECT 'legacy_end', NULL, strftime(last, '%Y-%m-%dT%H:%M:%S'), NULL, NULL, NULL, n, NULL FROM w"""


# Platform databases


def _database(s, label: str, table: str, columns: str, rows: DataFrame, by: str, index: str | None = None) -> str:
    """A folder of databases with ``rows`` as one table; every task writes one, of a range of ``by``, with an index on the column ``index``."""
    folder = local_path(work_folder(s, label))
    os.makedirs(folder)
    row = ", ".join("?" * len(rows.columns))

    def write(batches):
        path = f"{folder}/{TaskContext.get().partitionId():06d}.db"
        draft = f"{path}-{uuid.uuid4().hex}"  # a task that runs again puts its file in place of the first
        con = sqlite3.connect(draft)
        con.execute(f"CREATE TABLE {table} ({columns})")
        n = 0
        for batch in batches:
            con.executemany(f"INSERT INTO {table} VALUES ({row})", zip(*(c.to_pylist() for c in batch.columns)))
            n += batch.num_rows
        if index:
            con.execute(f"CREATE INDEX by_{index} ON {table} ({index})")
        con.commit()
        con.close()
        os.replace(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, by).sortWithinPartitions(*dict.fromkeys([by, *rows.columns])).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def _trace_database(s, d) -> str:
    info = F.to_json(F.struct(F.col("event_id").alias("post_id"), F.concat(F.lit("text "), "user_id").alias("content"), F.lit(1).alias("junk")))
    rows = model.table(s, d, "events").select("event_id", "user_id", _named(TRACE, "event_type").alias("action"), F.when(F.col("event_id") % 7 == 0, "no json").otherwise(info).alias("info"), F.col("ts").cast("string").alias("created_at"))
    return _database(s, "trace", "trace", "id INTEGER PRIMARY KEY, user_id INT, action TEXT, info TEXT, created_at TEXT", rows, "event_id")


def _trace(s, d) -> DataFrame:
    path = _trace_database(s, d)
    return readers.new_actions(s, path).select("rowid", "agent_id", "action_type", F.array_join(F.map_keys("action_args"), ",").alias("kept"), F.col("action_args")["content"].alias("content"))


def _db_posts(s, d) -> DataFrame:
    rows = model.table(s, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("order "), "o_orderkey"), F.col("o_orderdate").cast("string"))
    path = _database(s, "posts", "post", "post_id INTEGER PRIMARY KEY, user_id INT, content TEXT, created_at TEXT", rows, "o_orderkey")
    return readers.platform_posts(s, path, 50, 20).select("post_id", "user_id", "content")


def _db_comments(s, d) -> DataFrame:
    rows = model.table(s, d, "lineitem").select(F.expr("10 * l_orderkey + l_linenumber AS comment_id"), "l_orderkey", "l_suppkey", F.concat(F.lit("line "), "l_linenumber"), F.col("l_shipdate").cast("string"))
    path = _database(s, "comments", "comment", "comment_id INT, post_id INT, user_id INT, content TEXT, created_at TEXT", rows, "comment_id")
    return readers.platform_comments(s, path, None, 60, 10).select("comment_id", "post_id", "user_id", "content")


def _interview_trace(s, d) -> DataFrame:
    rows = model.interviews(s, d)
    info = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("plain "), "conv_id")).otherwise(F.to_json(F.struct("prompt", "response")))
    stamp = F.format_string("%012d-%06d", "conv_id", "turn")
    return rows.select("agent_id", F.lit("interview").alias("action"), info.alias("info"), stamp.alias("created_at"))


def _db_interviews(s, d) -> DataFrame:
    path = _database(s, "interviews", "trace", "user_id INT, action TEXT, info TEXT, created_at TEXT", _interview_trace(s, d), "created_at")
    return readers.interview_rows(s, path, None, 100).select("user_id", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"), "created_at")


def _db_latest_interview(s, d) -> DataFrame:
    path = _database(s, "interviews", "trace", "user_id INT, action TEXT, info TEXT, created_at TEXT", _interview_trace(s, d), "created_at")
    rows = readers.sqlite_rows(s, path, "trace", "rowid bigint, user_id bigint, info string, created_at string")
    return readers.last_positions(rows, "user_id", "created_at").select("user_id", "created_at")


TOLD_SQL = f"""{I}, t AS (SELECT agent_id AS user_id, prompt, response, conv_id, turn, printf('%012d-%06d', conv_id, turn) AS created_at FROM interviews)"""


# Documents, profiles, sections, states


def _write(folder: str, files: dict[str, bytes]) -> str:
    path = local_path(folder)
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "wb") as out:
            out.write(data)
    return path


def _nations(s, d) -> list:
    return model.table(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows


def _document_folder(s, d) -> str:
    files = {}
    for r in _nations(s, d):
        kind = ("txt", "md", "markdown", "exe")[r["n_nationkey"] % 4]
        files[f"n{r['n_nationkey']:02d}.{kind}"] = f"Nation {r['n_name']}\nRegion {r['n_regionkey']}: größer".encode()
    return _write(work_folder(s, "documents"), files)


def _files(s, d) -> DataFrame:
    rows = readers.documents(s, f"file://{_document_folder(s, d)}/*")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "text", "error")


FILES_SQL = """f AS (SELECT n_nationkey, printf('n%02d', n_nationkey) || ['.txt', '.md', '.markdown', '.exe'][n_nationkey % 4 + 1] AS file,
  CASE WHEN n_nationkey % 4 < 3 THEN 'Nation ' || n_name || chr(10) || 'Region ' || n_regionkey || ': größer' END AS text,
  CASE WHEN n_nationkey % 4 = 3 THEN 'unsupported file type: exe' END AS error FROM nation)"""


def _profile_files(s, d) -> DataFrame:
    """Both platforms' files, each read with the reader that falls back from one to the other."""
    folder = work_folder(s, "profiles")
    profiles = _profiles(s, d)
    sinks.write_twitter(profiles, f"{folder}/twitter")
    sinks.write_reddit(profiles, f"{folder}/reddit")
    csv = readers.profiles(s, None, f"{folder}/twitter").select(F.lit("twitter").alias("platform"), F.col("user_id").cast("long").alias("user_id"), "username", "bio", "profession", F.lit(None).cast("long").alias("karma"), F.lit(None).cast("string").alias("mbti"))
    rows = readers.profiles(s, f"{folder}/reddit", None, lines=True).select(F.lit("reddit").alias("platform"), F.col("user_id").cast("long").alias("user_id"), "username", "bio", "profession", F.col("karma").cast("long").alias("karma"), "mbti")
    return csv.unionByName(rows)


def _section_rows(s, d) -> DataFrame:
    return model.table(s, d, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("section_index"), F.col("n_name").alias("title"), F.concat(F.lit("about region "), "n_regionkey", F.lit("\n\nand more")).alias("body"))


def _section_files(s, d) -> DataFrame:
    folder = work_folder(s, "sections")
    sinks.write_sections(_section_rows(s, d), folder)
    rows = readers.sections(s, folder)
    return rows.select("section_index", F.regexp_replace("content", "\n$", "").alias("content"))


def _log_file(s, d) -> str:
    lines = []
    for r in _nations(s, d):
        k = r["n_nationkey"]
        lines.append(json.dumps({"line": k, "action": "tool_call", "name": r["n_name"]}) if k % 3 else f"[{k}] plain {r['n_name']}" if k % 2 else '{"torn": "' + r["n_name"])
    return _write(work_folder(s, "log"), {"agent_log.jsonl": "\n".join(lines).encode() + b"\n"}) + "/agent_log.jsonl"


STATE_SCHEMA = "STRUCT<simulation_id: STRING, runner_status: STRING, current_round: INT>"


def _states(s, d) -> dict[str, bytes]:
    files = {}
    for r in _nations(s, d):
        k = r["n_nationkey"]
        state = {"simulation_id": f"sim_{k}", "project_id": f"proj_{k % 3}", "status": ("ready", "running", "completed")[k % 3], "created_at": f"2024-01-{k + 1:02d}"}
        if k % 2:
            state |= {"runner_status": "running", "current_round": k, "total_rounds": 40, "twitter_actions_count": 3 * k}
        files[f"sim_{k}/state.json"] = json.dumps(state, indent=1).encode()
    return files


def _run_states(s, d) -> DataFrame:
    folder = _write(work_folder(s, "states"), _states(s, d))
    raw = s.read.text(f"file://{folder}/*/state.json", wholetext=True)
    return reports.run_states(raw).select("simulation_id", "runner_status", "current_round", "total_rounds", "twitter_actions_count", "reddit_actions_count", F.size("recent_actions").alias("recent"))


def _listing(s, d) -> DataFrame:
    folder = _write(work_folder(s, "states"), _states(s, d))
    return readers.listing(s, f"file://{folder}/*/state.json", newest="created_at", limit=4, project_id="proj_1").select("simulation_id", "status", "created_at")


def _config_files(s, d) -> DataFrame:
    files = {}
    for r in _nations(s, d):
        k = r["n_nationkey"]
        config = {"agent_configs": [{"agent_id": i} for i in range(k)], "event_config": {"initial_posts": [{}] * (k % 4), "hot_topics": ["a", "b"][: k % 3]}}
        if k % 2:
            config["twitter_config"] = None
        if k % 5 == 0:
            config["reddit_config"] = {"x": 1}
        files[f"{k}.json"] = json.dumps(config).encode()
    return readers.config_summary(s, f"file://{_write(work_folder(s, 'configs'), files)}/*.json")


# Streams over logs that were written


def _streamed(s, frame: DataFrame, mode: str) -> DataFrame:
    """The rows of a finished stream, in a table; the last of each key where rows are updates."""
    folder = work_folder(s, "stream")

    def save(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).start()
    query.processAllAvailable()
    query.stop()
    return s.read.parquet(f"{folder}/out")


def _log_folder(s, d) -> str:
    """The platforms' logs as JSON lines, written by tasks, with control records and torn lines in a file of their own."""
    folder = local_path(work_folder(s, "logs"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    rows = model.actions(s, d).select("platform", F.col("round").cast("int").alias("round"), stamp, "agent_id", "agent_name", "action_type")
    rows.write.partitionBy("platform").json(f"file://{folder}")
    control = s.createDataFrame([('{"event_type": "simulation_end", "round": 5}',), ("not json",), ("",)], "value string")
    control.coalesce(1).write.mode("append").text(f"file://{folder}/platform=twitter")
    return folder


def _stream_state(s, d) -> DataFrame:
    rows = streams.parsed(streams.log_stream(s, _log_folder(s, d)))
    out = _streamed(s, streams.run_state(rows), "update")
    return out.groupBy("platform").agg(F.max_by(F.struct("actions", "current_round", "completed"), "_batch").alias("x")).select("platform", "x.*")


def _stream_batches(s, d) -> DataFrame:
    rows = streams.parsed(streams.log_stream(s, _log_folder(s, d)))
    told = rows.select("platform", F.when(F.col("event_type").isNull(), F.col("agent_name")).alias("text"))
    return _streamed(s, streams.count_batches(told), "append").groupBy("platform").agg(F.count("*").alias("batches"), F.sum("n").alias("actions"), F.max("n").alias("largest"))


def _simulated(s, d) -> DataFrame:
    """A stream of the actions of twenty simulations, of which every second one ends, from files that tasks write."""
    folder = work_folder(s, "simulations")
    told = model.actions(s, d).select("platform", F.concat(F.lit("sim_"), F.col("agent_id") % 20).alias("simulation"), "seq", F.col("seq").cast("string").alias("text"), F.lit(None).cast("string").alias("event_type"), F.col("round").cast("int").alias("round"))
    ends = told.where("substr(simulation, 5) % 2 = 0").groupBy("platform", "simulation").agg((F.max("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("text"), F.lit("simulation_end").alias("event_type"), F.max("round").alias("round"))
    told.unionByName(ends).write.json(folder)
    return s.readStream.schema(told.schema).json(folder)


def _stream_timed_batches(s, d) -> DataFrame:
    """What a batching stream gives of all rows that are there; the rest of simulations that go on waits."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = s.conf.get(key)
    s.conf.set(key, "false")  # no epochs for timers alone: the query ends
    try:
        out = _streamed(s, stateful.timed_batches(_simulated(s, d)), "append")
    finally:
        s.conf.set(key, before)
    each = out.select("platform", "simulation", "batch", "n", F.explode(F.transform(F.split("text", "\n"), lambda x: x.cast("long"))).alias("seq"))
    return each.groupBy("platform", "simulation").agg(F.countDistinct("batch").alias("batches"), F.count("*").alias("actions"), F.max("n").alias("largest"), F.sum("seq").alias("seqs"))


def _stream_progress(s, d) -> DataFrame:
    out = _streamed(s, stateful.progress(_simulated(s, d)), "update")
    last = out.groupBy("platform", "simulation").agg(F.max_by(F.struct("actions", "current_round", "completed"), "_batch").alias("x"))
    return last.select("platform", "simulation", "x.*")


def _stream_memory(s, d) -> DataFrame:
    """A trace database followed by row ids, a few thousand an epoch, and appended to a graph's memory."""
    path = _trace_database(s, d)
    folder = local_path(work_folder(s, "memory"))
    most = max(1000, model.table(s, d, "events").count() // 8)
    rows = readers.sqlite_changes(s, path, "trace", readers.TRACE_ROWS, most=most, progress=f"{folder}/progress")
    acts = readers.as_actions(rows).select("rowid", "agent_id", "action_type", F.col("action_args")["content"].alias("content"))
    query = episodes.append_episodes(acts, f"{folder}/episodes", f"file://{folder}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return episodes.episodes(s, f"file://{folder}/episodes", "rowid long, agent_id long, action_type string, content string")


def _stream_dedupe(s, d) -> DataFrame:
    rows = streams.parsed(streams.log_stream(s, _log_folder(s, d))).where("event_type is null")
    return _streamed(s, streams.deduplicated(rows), "append").groupBy("platform").agg(F.count("*").alias("actions"))


def _stream_windows(s, d) -> DataFrame:
    rows = streams.parsed(streams.log_stream(s, _log_folder(s, d))).where("event_type is null")
    out = _streamed(s, streams.windowed(rows, "6 hours"), "update")
    last = out.groupBy("window", "platform").agg(F.max_by("n", "_batch").alias("n"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "platform", "n")


QUERIES = {
    "action_log_files": (
        _action_log,
        f"""{A} SELECT seq, platform, agent_id, action_type, CAST(round AS INTEGER) AS round, {ISO.format('"timestamp"')} AS "timestamp", value > 100 AS success FROM actions""",
    ),
    "control_log_files": (_control_log, CONTROL_SQL),
    "sqlite_trace": (
        _trace,
        f"""WITH t AS (SELECT event_id AS rowid, user_id AS agent_id, {TRACE_SQL} AS action, event_id % 7 <> 0 AS good FROM events)
        SELECT rowid, agent_id, upper(action) AS action_type, CASE WHEN good THEN 'post_id,content' ELSE '' END AS kept, CASE WHEN good THEN 'text ' || agent_id END AS content FROM t WHERE action <> 'sign_up'""",
    ),
    "sqlite_posts": (_db_posts, "SELECT o_orderkey AS post_id, o_custkey AS user_id, 'order ' || o_orderkey AS content FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20"),
    "sqlite_comments": (
        _db_comments,
        "SELECT 10 * l_orderkey + l_linenumber AS comment_id, l_orderkey AS post_id, l_suppkey AS user_id, 'line ' || l_linenumber AS content FROM lineitem ORDER BY l_shipdate DESC, comment_id DESC LIMIT 60 OFFSET 10",
    ),
    "sqlite_interviews": (
        _db_interviews,
        f"""{TOLD_SQL} SELECT user_id, md5(CASE WHEN turn % 4 <> 2 THEN prompt END) AS prompt, md5(CASE WHEN turn % 4 <> 2 THEN response ELSE 'plain ' || conv_id END) AS response, created_at FROM t ORDER BY created_at DESC LIMIT 100""",
    ),
    "sqlite_latest_interview": (_db_latest_interview, f"{TOLD_SQL} SELECT user_id, max(created_at) AS created_at FROM t GROUP BY user_id"),
    "document_files": (_files, f"WITH {FILES_SQL} SELECT file, text, error FROM f"),
    "joined_document_files": (
        lambda s, d: readers.joined_documents(readers.documents(s, f"file://{_document_folder(s, d)}/*")),
        f"""WITH {FILES_SQL} SELECT string_agg('=== Document ' || (n_nationkey + 1) || ': ' || file || ' ===' || chr(10) || coalesce(text, '[could not be read: ' || error || ']'), chr(10) || chr(10) ORDER BY file) AS text FROM f""",
    ),
    "profile_files": (
        _profile_files,
        f"""{G} SELECT 'twitter' AS platform, row_number() OVER (ORDER BY agent_id) - 1 AS user_id, lower(replace(name, '#', '_')) AS username, 'bio of ' || name || ' ' || repeat('x', 140) AS bio, 'unknown' AS profession, CAST(NULL AS BIGINT) AS karma, CAST(NULL AS VARCHAR) AS mbti FROM agents
        UNION ALL SELECT 'reddit', agent_id, lower(replace(name, '#', '_')), left('bio of' || chr(10) || name || ' ' || repeat('x', 140), 150), entity_type, 1000, CASE WHEN agent_id % 5 = 0 THEN 'INTJ' ELSE 'ISTJ' END FROM agents""",
    ),
    "section_files": (
        _section_files,
        "SELECT CAST(n_nationkey + 1 AS INTEGER) AS section_index, '## ' || n_name || chr(10) || chr(10) || 'about region ' || n_regionkey || chr(10) || chr(10) || 'and more' AS content FROM nation",
    ),
    "assembled_report": (
        lambda s, d: sinks.assembled_report("Title", "Summary", _section_rows(s, d)),
        """SELECT '# Title' || chr(10) || chr(10) || '> Summary' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
        string_agg('## ' || n_name || chr(10) || chr(10) || 'about region ' || n_regionkey || chr(10) || chr(10) || 'and more', chr(10) || chr(10) ORDER BY n_nationkey) AS report FROM nation""",
    ),
    "agent_log_tail": (
        lambda s, d: readers.agent_log(s, f"file://{_log_file(s, d)}", 5).select(F.col("line").cast("long").alias("line"), F.get_json_object("value", "$.name").alias("name")),
        "SELECT CAST(n_nationkey AS BIGINT) AS line, n_name AS name FROM nation WHERE n_nationkey >= 5 AND n_nationkey % 3 <> 0",
    ),
    "console_log_tail": (
        lambda s, d: readers.log_lines(s, f"file://{_log_file(s, d)}", 7).select(F.col("line").cast("long").alias("line"), F.length("value").cast("long").alias("n")),
        """SELECT CAST(n_nationkey AS BIGINT) AS line, CAST(CASE WHEN n_nationkey % 3 <> 0 THEN length('{"line": , "action": "tool_call", "name": ""}') + length(n_nationkey || n_name)
        WHEN n_nationkey % 2 = 1 THEN length('[] plain ') + length(n_nationkey || n_name) ELSE length('{"torn": "') + length(n_name) END AS BIGINT) AS n FROM nation WHERE n_nationkey >= 7""",
    ),
    "run_state_files": (
        _run_states,
        """SELECT 'sim_' || n_nationkey AS simulation_id, CASE WHEN n_nationkey % 2 = 1 THEN 'running' ELSE 'idle' END AS runner_status, CAST(CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey ELSE 0 END AS INTEGER) AS current_round,
        CAST(CASE WHEN n_nationkey % 2 = 1 THEN 40 ELSE 0 END AS INTEGER) AS total_rounds, CAST(CASE WHEN n_nationkey % 2 = 1 THEN 3 * n_nationkey ELSE 0 END AS BIGINT) AS twitter_actions_count, CAST(0 AS BIGINT) AS reddit_actions_count, CAST(0 AS INTEGER) AS recent FROM nation""",
    ),
    "state_listing": (
        _listing,
        "SELECT 'sim_' || n_nationkey AS simulation_id, ['ready', 'running', 'completed'][n_nationkey % 3 + 1] AS status, printf('2024-01-%02d', n_nationkey + 1) AS created_at FROM nation WHERE n_nationkey % 3 = 1 ORDER BY created_at DESC LIMIT 4",
    ),
    "config_files": (
        _config_files,
        "SELECT CAST(n_nationkey AS INTEGER) AS n_agents, CAST(n_nationkey % 4 AS INTEGER) AS n_posts, CAST(n_nationkey % 3 AS INTEGER) AS n_topics, n_nationkey % 2 = 1 AS has_twitter_config, n_nationkey % 5 = 0 AS has_reddit_config FROM nation",
    ),
    "stream_run_state": (
        _stream_state,
        f"""{A} SELECT platform, count(*) AS actions, CAST(greatest(max(round), CASE WHEN platform = 'twitter' THEN 5 ELSE 0 END) AS INTEGER) AS current_round, platform = 'twitter' AS completed FROM actions GROUP BY platform""",
    ),
    "stream_batches": (
        _stream_batches,
        f"{A}, n AS (SELECT platform, CASE WHEN platform = 'twitter' THEN count(*) ELSE count(*) // 5 * 5 END AS n FROM actions GROUP BY 1) SELECT platform, CAST(ceil(n / 5.0) AS BIGINT) AS batches, CAST(n AS BIGINT) AS actions, CAST(5 AS BIGINT) AS largest FROM n",
    ),
    "stream_timed_batches": (
        _stream_timed_batches,
        f"""{A}, t AS (SELECT platform, 'sim_' || agent_id % 20 AS simulation, agent_id % 2 = 0 AS ended, seq FROM actions), p AS (SELECT *, row_number() OVER (PARTITION BY platform, simulation ORDER BY seq) AS place, count(*) OVER (PARTITION BY platform, simulation) AS n FROM t)
        SELECT platform, simulation, CAST(ceil(count(*) / 5.0) AS BIGINT) AS batches, count(*) AS actions, least(count(*), 5) AS largest, CAST(sum(seq) AS BIGINT) AS seqs FROM p WHERE ended OR place <= n // 5 * 5 GROUP BY platform, simulation""",
    ),
    "stream_progress": (
        _stream_progress,
        f"""{A} SELECT platform, 'sim_' || agent_id % 20 AS simulation, count(*) AS actions, CAST(max(round) AS INTEGER) AS current_round, bool_or(agent_id % 2 = 0) AS completed FROM actions GROUP BY 1, 2""",
    ),
    "stream_memory": (
        _stream_memory,
        f"""WITH t AS (SELECT event_id AS rowid, user_id AS agent_id, {TRACE_SQL} AS action, event_id % 7 <> 0 AS good FROM events)
        SELECT rowid, agent_id, upper(action) AS action_type, CASE WHEN good THEN 'text ' || agent_id END AS content FROM t WHERE action <> 'sign_up'""",
    ),
    "stream_dedupe": (
        _stream_dedupe,
        f"""{A} SELECT platform, count(DISTINCT (date_trunc('second', "timestamp"), agent_id, action_type)) AS actions FROM actions GROUP BY platform""",
    ),
    "stream_windows": (
        _stream_windows,
        f"""{A} SELECT strftime(time_bucket(INTERVAL '6 hours', date_trunc('second', "timestamp"), TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, platform, count(*) AS n FROM actions GROUP BY 1, 2""",
    ),
}
