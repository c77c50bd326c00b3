"""Queries over what runs a simulation and writes its report: rounds, commands, clean-up, retries, a scripted model."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens import sinks
from swarmlens.functions import render, rules
from swarmlens.plans import report
from swarmlens.queries.files import _log_folder, _write
from swarmlens.sources import model, readers
from swarmlens.sources.folders import work_folder
from swarmlens.streaming import actions as streams

NE = f"WITH {model.NODES_SQL}, {model.EDGES_SQL}"


def _command(s, d) -> DataFrame:
    """The oldest command is torn, so the next one is due."""
    folder = _write(work_folder(s, "commands"), {f"{k}.json": json.dumps({"id": k, "nation": r["n_name"]}).encode() if k else b"{\"id\": 0," for k, r in enumerate(model.table(s, d, "nation").orderBy("n_nationkey").collect())})
    for k in range(25):
        os.utime(f"{folder}/{k}.json", (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    return readers.next_command(s, f"file://{folder}").select(F.get_json_object("command", "$.id").cast("long").alias("id"), F.get_json_object("command", "$.nation").alias("nation"))


def _cleaned(s, d) -> DataFrame:
    names = [n for k, n in enumerate(sinks.RUN_FILES) if k % 2 == 0]
    folder = _write(work_folder(s, "run"), dict.fromkeys([*names, "simulation_config.json"], b"x"))
    gone = sinks.cleaned_run(folder)
    kept = sorted(os.listdir(folder))
    return s.createDataFrame([(n, e, not os.path.exists(f"{folder}/{n}")) for n, e in gone] + [(n, "kept", False) for n in kept if n.endswith("config.json")], "file string, error string, gone boolean")


def _saved(s, d) -> DataFrame:
    folder = _write(work_folder(s, "project"), {})
    rows = [sinks.saved_file(folder, f"{r['r_name']}.TXT", r["r_name"].encode()) for r in model.table(s, d, "region").collect()]  # 5 rows
    frame = s.createDataFrame(rows, "original string, saved string, size long")
    return frame.select("original", F.regexp_like("saved", F.lit("^[0-9a-f]{8}[.]txt$")).alias("named"), "size")


def _retried(s, d) -> DataFrame:
    """Pages that fail so many times before they come: after three tries the error stands."""
    out = []
    for fails in range(4):
        waits: list[float] = []
        left = [fails]

        def fetch():
            if left[0]:
                left[0] -= 1
                raise ConnectionError("no answer")
            return "page"

        try:
            got = readers.page_with_retry(fetch, sleep=waits.append)
        except ConnectionError as e:
            got = str(e)
        out.append((fails, got, float(sum(waits))))
    return s.createDataFrame(out, "fails int, got string, waited double")


def _updaters(s, d) -> DataFrame:
    """One stream for each platform's log; all end once their input is read."""
    logs, folder = _log_folder(s, d), work_folder(s, "updaters")
    running = {}
    for platform in ("twitter", "reddit"):
        rows = streams.parsed(streams.log_stream(s, logs)).where(F.col("platform") == platform)
        running[platform] = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{platform}").format("noop").start()
    return s.createDataFrame(list(streams.finished(running).items()), "platform string, done boolean")


def _scripted(prompt: str) -> str:
    """A model that calls three tools, tries to end early once, and reports the last result it saw."""
    if prompt.startswith("Outline"):
        return 'Sure: {"title": "T", "sections": [{"title": "Size"}, "Parts"]}' if "give" in prompt else "no idea"
    results = [x for x in prompt.split("\n") if x.startswith("Result")]
    if not results and "Tools called" not in prompt:
        return "Final Answer: too early"
    if len(results) < 3:
        return '<tool_call>{"name": "quick_search", "parameters": {"query": "part of region", "limit": 1}}</tool_call>'
    return "Thought. Final Answer: " + results[-1]


def _reports(s, d) -> DataFrame:
    nodes, edges = model.nodes(s, d), model.edges(s, d)
    planned = report.written("please give one", _scripted, nodes, edges)
    fallback = [(k, t, "", 0) for k, t in enumerate(report.outline("nothing", "", _scripted)[1], 1)]
    chat = report.answered("how many?", "r" * 20_000, [("user", "hi")] * 30, lambda p: f"seen {len(p) < 15_400}", nodes, edges)
    return s.createDataFrame([("planned", *r) for r in planned] + [("fallback", *r) for r in fallback] + [("chat", 0, "", chat, 0)], "kind string, section_index int, title string, text string, calls int")


QUERIES = {
    "round_agents": (
        lambda s, d: rules.round_agents(model.agents(s, d), 30),
        f"""WITH {model.AGENTS_SQL}, r AS (SELECT agent_id, CAST(round AS INTEGER) AS round, CAST(round % 24 AS INTEGER) AS hour, entity_type, CAST(('0x' || substr(md5(round || ':' || agent_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
          CASE entity_type WHEN 'University' THEN 0.2 WHEN 'MediaOutlet' THEN 0.5 WHEN 'Professor' THEN 0.4 WHEN 'Student' THEN 0.8 ELSE 0.7 END AS level FROM agents, range(30) AS x(round)),
        awake AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY u, agent_id) AS i FROM r WHERE u < level AND CASE entity_type WHEN 'University' THEN hour BETWEEN 9 AND 17 WHEN 'MediaOutlet' THEN hour >= 7 WHEN 'Professor' THEN hour BETWEEN 8 AND 21
          WHEN 'Student' THEN hour BETWEEN 8 AND 13 OR hour >= 18 ELSE hour BETWEEN 9 AND 13 OR hour >= 18 END)
        SELECT round, agent_id FROM awake WHERE i <= least(30, greatest(10, floor(30 * CASE WHEN hour BETWEEN 19 AND 22 THEN 1.5 WHEN hour <= 5 THEN 0.05 ELSE 1.0 END)))""",
    ),
    "next_command": (_command, "SELECT CAST(1 AS BIGINT) AS id, n_name AS nation FROM nation WHERE n_nationkey = 1"),
    "cleaned_run": (
        _cleaned,
        "SELECT f AS file, '' AS error, true AS gone FROM (VALUES ('run_state.json'), ('stdout.log'), ('twitter_simulation.db'), ('env_status.json'), ('reddit/actions.jsonl')) AS v(f) UNION ALL SELECT 'simulation_config.json', 'kept', false",
    ),
    "saved_files": (_saved, "SELECT r_name || '.TXT' AS original, true AS named, CAST(length(r_name) AS BIGINT) AS size FROM region"),
    "page_retries": (_retried, "SELECT * FROM (VALUES (0, 'page', 0.0), (1, 'page', 2.0), (2, 'page', 6.0), (3, 'no answer', 6.0)) AS v(fails, got, waited)"),
    "back_off": (
        lambda s, d: model.table(s, d, "nation").select("n_nationkey", rules.back_off(F.col("n_nationkey")).alias("seconds")),
        "SELECT n_nationkey, least(30.0, pow(2, n_nationkey)) AS seconds FROM nation",
    ),
    "stream_registry": (_updaters, "SELECT * FROM (VALUES ('twitter', true), ('reddit', true)) AS v(platform, done)"),
    "html_forms": (
        lambda s, d: model.table(s, d, "nation").select("n_nationkey", render.html(F.concat(F.lit("## "), "n_name", F.lit("\n> said\n\n- **bold** & *light*\n- `x < 1`\n---\nend"))).alias("html")),
        """SELECT n_nationkey, '<p><h2>' || n_name || '</h2>' || chr(10) || '<blockquote>said</blockquote></p><p><li><strong>bold</strong> &amp; <em>light</em></li>' || chr(10) || '<li><code>x &lt; 1</code></li>' || chr(10) || '<hr>' || chr(10) || 'end</p>' AS html FROM nation""",
    ),
    "type_sources": (
        lambda s, d: model.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.when(F.col("n_regionkey") > 0, F.lower("n_name")))).alias("a")).select("n_regionkey", render.type_source(F.concat(F.lit("Region"), "n_regionkey"), F.lit("A region."), F.col("a")).alias("source")),
        """SELECT n_regionkey, 'class Region' || n_regionkey || ':' || chr(10) || '    \"\"\"A region.\"\"\"' || coalesce(chr(10) || string_agg('    ' || lower(n_name) || ': str | None = None', chr(10) ORDER BY lower(n_name)) FILTER (WHERE n_regionkey > 0), '') AS source FROM nation GROUP BY n_regionkey""",
    ),
    "report_runs": (
        _reports,
        f"""{NE}, top AS (SELECT fact FROM edges ORDER BY CASE WHEN contains(lower(fact), 'part of region') THEN 100 ELSE CASE WHEN contains(lower(fact), 'part') THEN 10 ELSE 0 END + CASE WHEN contains(lower(fact), 'of') THEN 10 ELSE 0 END + CASE WHEN contains(lower(fact), 'region') THEN 10 ELSE 0 END END
          + CASE WHEN contains(lower(name), 'part') THEN 10 ELSE 0 END + CASE WHEN contains(lower(name), 'of') THEN 10 ELSE 0 END DESC, id LIMIT 1)
        SELECT 'planned' AS kind, i AS section_index, title, 'Result 3: Query: part of region' AS text, 3 AS calls FROM (VALUES (1, 'Size'), (2, 'Parts')) AS v(i, title), top
        UNION ALL SELECT 'fallback', i, title, '', 0 FROM (VALUES (1, 'Findings'), (2, 'Groups'), (3, 'Outlook')) AS w(i, title) UNION ALL SELECT 'chat', 0, '', 'seen True', 0""",
    ),
}
