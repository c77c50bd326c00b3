"""Queries over report logs, states and rendered results."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens import sinks
from swarmlens.functions import render, rules
from swarmlens.operators import actions, graph, reports
from swarmlens.plans import tools
from swarmlens.sources import model, readers
from swarmlens.sources.folders import work_folder

NAMES = {"click": "tool_call", "view": "section_complete", "purchase": "llm_response", "signup": "planning_complete", "error": "report_complete"}
LOG_SQL = "log AS (SELECT user_id AS report_id, event_id AS line, CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'section_complete' WHEN 'purchase' THEN 'llm_response' WHEN 'signup' THEN 'planning_complete' ELSE 'report_complete' END AS action, CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 AS section_index, value AS elapsed FROM events)"

PROGRESS_SQL = f"""WITH {LOG_SQL}, p AS (SELECT report_id, line, CASE action WHEN 'report_complete' THEN 'completed' WHEN 'planning_complete' THEN 'planning' ELSE 'generating' END AS status, section_index FROM log),
  l AS (SELECT report_id, arg_max(status, line) AS status, arg_max(section_index, line) AS current_section FROM p GROUP BY report_id)
SELECT report_id, status, CAST(20 + floor(70 * current_section / 9.0) AS INTEGER) AS progress, 'section ' || current_section AS message, current_section FROM l"""


def _log(s, d):
    named = F.try_element_at(F.create_map(*(F.lit(x) for p in NAMES.items() for x in p)), F.col("event_type"))
    return model.table(s, d, "events").select(
        F.col("user_id").alias("report_id"), F.col("event_id").alias("line"), named.alias("action"), (F.get_json_object("props", "$.k").cast("int") % 9).alias("section_index"), F.col("value").alias("elapsed"),
        F.concat(F.lit('{"content": "c'), "event_id", F.lit('"}')).alias("details"),
    )


def _written_log(s, d):
    """The log through its files, with torn lines among them."""
    folder = work_folder(s, "report-log")
    sinks.append_report_log(_log(s, d), folder)
    s.createDataFrame([('{"report_id": 1, "action": "tool_c',), ("",)], "value string").coalesce(1).write.mode("append").text(folder)
    return readers.report_log(s, folder)


def _written_progress(s, d):
    folder = work_folder(s, "progress")
    status = F.when(F.col("action") == "report_complete", "completed").when(F.col("action") == "planning_complete", "planning").otherwise("generating")
    rows = _log(s, d).select("report_id", "line", status.alias("status"), rules.report_progress(F.col("section_index"), F.lit(9)).cast("int").alias("progress"), F.concat(F.lit("section "), "section_index").alias("message"), F.col("section_index").alias("current_section"))
    for part in (0, 1):  # two runs append to one folder
        sinks.append_progress(rows.where(F.col("line") % 2 == part), folder)
    return readers.latest_progress(s, folder)


QUERIES = {
    "report_log_files": (
        lambda s, d: _written_log(s, d).select("report_id", "line", "action", "section_index", "elapsed", F.get_json_object("details", "$.content").alias("content")),
        f"WITH {LOG_SQL} SELECT report_id, line, action, section_index, elapsed, 'c' || line AS content FROM log",
    ),
    "report_log_read_back": (
        lambda s, d: reports.last_sections(_written_log(s, d)),
        f"WITH {LOG_SQL} SELECT report_id, section_index, 'c' || max(line) AS content FROM log WHERE action = 'section_complete' GROUP BY ALL",
    ),
    "progress_files": (_written_progress, PROGRESS_SQL),
    "report_log_summary": (
        lambda s, d: reports.log_summary(_log(s, d)),
        f"""WITH {LOG_SQL} SELECT report_id, count(*) FILTER (WHERE action = 'tool_call') AS tool_calls, count(DISTINCT section_index) FILTER (WHERE action = 'section_complete') AS sections_done,
        bool_or(action = 'planning_complete') AS planned, bool_or(action = 'report_complete') AS complete, arg_max(elapsed, line) AS elapsed FROM log GROUP BY report_id""",
    ),
    "report_steps": (
        lambda s, d: reports.step_status(reports.log_summary(_log(s, d))),
        f"""WITH {LOG_SQL}, s AS (SELECT report_id, bool_or(action = 'planning_complete') AS planned, bool_or(action = 'report_complete') AS complete FROM log GROUP BY 1)
        SELECT report_id, 'planning' AS step, CASE WHEN planned THEN 'done' ELSE 'active' END AS status FROM s UNION ALL
        SELECT report_id, 'writing', CASE WHEN complete THEN 'done' WHEN planned THEN 'active' ELSE 'todo' END FROM s UNION ALL SELECT report_id, 'complete', CASE WHEN complete THEN 'done' ELSE 'todo' END FROM s""",
    ),
    "section_progress": (
        lambda s, d: reports.log_summary(_log(s, d)).select("report_id", reports.section_progress(F.col("sections_done"), F.lit(9)).alias("percent")),
        f"WITH {LOG_SQL} SELECT report_id, CAST(round(100 * count(DISTINCT section_index) FILTER (WHERE action = 'section_complete') / 9.0) AS INTEGER) AS percent FROM log GROUP BY report_id",
    ),
    "report_sections": (
        lambda s, d: reports.last_sections(_log(s, d)),
        f"WITH {LOG_SQL} SELECT report_id, section_index, 'c' || max(line) AS content FROM log WHERE action = 'section_complete' GROUP BY ALL",
    ),
    "recent_by_agent": (
        lambda s, d: reports.recent_ring(model.actions(s, d), "agent_id", 3).select("agent_id", "seq"),
        f"""WITH {model.ACTIONS_SQL} SELECT agent_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY "timestamp" DESC, seq DESC) AS i FROM actions) WHERE i <= 3""",
    ),
    "both_platforms": (
        lambda s, d: reports.both_platforms(model.actions(s, d).withColumn("platform", F.when(F.col("seq") % 3 > 0, F.col("platform")))).groupBy("platform").agg(F.count("*").alias("n")),
        f"WITH {model.ACTIONS_SQL}, x AS (SELECT seq, unnest(CASE WHEN seq % 3 > 0 THEN [platform] ELSE ['twitter', 'reddit'] END) AS platform FROM actions) SELECT platform, count(*) AS n FROM x GROUP BY 1",
    ),
    "action_labels": (
        lambda s, d: actions.histogram(model.actions(s, d).withColumn("action_type", render.action_label(F.concat(F.upper("action_type"), F.lit("_POST")))), "platform"),
        f"WITH {model.ACTIONS_SQL} SELECT platform, upper(action_type) || '_POST' AS action_type, count(*) AS n FROM actions GROUP BY ALL",
    ),
    "edge_texts": (
        lambda s, d: graph.with_short_names(model.edges(s, d), model.nodes(s, d)).select(
            "id", F.md5(render.edge_text(F.col("source_name"), F.col("name"), F.col("target_name"), F.col("fact"), F.date_format("valid_at", "yyyy-MM-dd"), F.date_format("invalid_at", "yyyy-MM-dd"), F.date_format("expired_at", "yyyy-MM-dd"))).alias("digest")),
        f"""WITH {model.NODES_SQL}, {model.EDGES_SQL} SELECT e.id, md5('Relation: ' || coalesce(nullif(a.name, ''), left(source, 8)) || ' --[' || e.name || ']--> ' || coalesce(nullif(b.name, ''), left(target, 8)) || chr(10) || 'Fact: ' || fact || chr(10) || 'Valid: ' ||
        coalesce(strftime(valid_at, '%Y-%m-%d'), 'unknown') || ' - ' || coalesce(strftime(invalid_at, '%Y-%m-%d'), 'now') || coalesce(' (expired: ' || strftime(expired_at, '%Y-%m-%d') || ')', '')) AS digest
        FROM edges e LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target""",
    ),
    "node_texts": (
        lambda s, d: model.nodes(s, d).select("id", render.node_text(F.col("name"), graph.entity_type(), F.col("summary")).alias("text")),
        f"WITH {model.NODES_SQL} SELECT id, 'Entity: ' || name || ' (type: ' || coalesce(list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))[1], 'unknown') || ')' || chr(10) || 'Summary: ' || summary AS text FROM nodes",
    ),
    "profile_rules": (
        lambda s, d: tools.profile_rules(graph.typed_entities(model.nodes(s, d))).select("id", "age", "gender", "profession", F.array_join("interested_topics", ",").alias("topics")),
        f"""WITH {model.NODES_SQL}, t AS (SELECT *, list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))[1] AS k FROM nodes)
        SELECT id, CAST(25 + floor(CAST(('0x' || substr(md5(name || ':age'), 1, 8)) AS BIGINT) / 4294967296.0 * 26) AS INTEGER) AS age,
        CASE WHEN CAST(('0x' || substr(md5(name || ':gender'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.5 THEN 'male' ELSE 'female' END AS gender, k AS profession, 'General,Social Issues' AS topics FROM t WHERE k IS NOT NULL""",
    ),
    "short_ids": (
        lambda s, d: model.nodes(s, d).select("id", render.short_id(F.col("name")).alias("short"), render.short_file(F.concat("name", F.lit(".parquet"))).alias("file")),
        f"WITH {model.NODES_SQL} SELECT id, upper(left(name, 6)) AS short, CASE WHEN length(name) + 8 <= 20 THEN name || '.parquet' ELSE left(name, 9) || '....parquet' END AS file FROM nodes",
    ),
}
