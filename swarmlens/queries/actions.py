"""Queries over actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens.functions import rules, text
from swarmlens.operators import actions as ops
from swarmlens.sources import model

A = "WITH " + model.ACTIONS_SQL
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}"
COUNTS = "count(*) FILTER (WHERE platform = 'twitter') AS twitter_actions, count(*) FILTER (WHERE platform = 'reddit') AS reddit_actions, count(*) AS total_actions"
ORDER = 'ORDER BY "timestamp" DESC, platform DESC, seq'
PAGE = ["seq", "platform", "agent_id", "action_type", "round"]


def _times(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _timed(sql: str) -> str:
    return f"{TIME.format(f'min({sql})', 'first_action_time')}, {TIME.format(f'max({sql})', 'last_action_time')}"


def _episodes(actions):
    args = F.create_map(F.lit("content"), F.concat(F.lit("item "), F.col("k").cast("string")))
    return actions.withColumn("text", text.episode("agent_name", rules.standard_action("action_type"), args))


STANDARD = "CASE action_type WHEN 'click' THEN 'LIKE_POST' WHEN 'view' THEN 'SEARCH_POSTS' WHEN 'purchase' THEN 'CREATE_POST' WHEN 'signup' THEN 'FOLLOW' ELSE upper(action_type) END"


def _mapped(actions):
    """Event types of the test tables as platform actions."""
    names = {"click": "like_post", "view": "search_posts", "purchase": "create_post", "signup": "follow"}
    return actions.withColumn("action_type", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), "action_type"), F.col("action_type")))


QUERIES = {
    "timeline": (
        lambda s, d: _times(ops.timeline(model.actions(s, d)), "first_action_time", "last_action_time"),
        f"{A} SELECT round, {COUNTS}, count(DISTINCT agent_id) AS active_agents, {_timed('\"timestamp\"')} FROM actions GROUP BY round",
    ),
    "timeline_range": (
        lambda s, d: _times(ops.timeline(model.actions(s, d), 24, 48, compat=True), "first_action_time", "last_action_time"),
        f"{A} SELECT round, {COUNTS}, count(DISTINCT agent_id) AS active_agents, {TIME.format('max(\"timestamp\")', 'first_action_time')}, {TIME.format('min(\"timestamp\")', 'last_action_time')} FROM actions WHERE round BETWEEN 24 AND 48 GROUP BY round",
    ),
    "timeline_action_types": (
        lambda s, d: ops.histogram(model.actions(s, d), "round"),
        f"{A} SELECT round, action_type, count(*) AS n FROM actions GROUP BY ALL",
    ),
    "agent_stats": (
        lambda s, d: _times(ops.agent_stats(model.actions(s, d)), "first_action_time", "last_action_time"),
        f"{A} SELECT agent_id, max('Agent_' || agent_id) AS agent_name, {COUNTS}, {_timed('\"timestamp\"')} FROM actions GROUP BY agent_id",
    ),
    "agent_action_types": (
        lambda s, d: ops.histogram(model.actions(s, d), "agent_id"),
        f"{A} SELECT agent_id, action_type, count(*) AS n FROM actions GROUP BY ALL",
    ),
    "run_progress": (
        lambda s, d: ops.progress(model.actions(s, d), 800),
        f"{A} SELECT coalesce(max(round), 0) AS current_round, {COUNTS}, round_even(coalesce(max(round), 0) / 800.0 * 100, 1) AS progress_percent, coalesce(max(round), 0) AS simulated_hours FROM actions",
    ),
    "recent_actions": (
        lambda s, d: ops.recent(model.actions(s, d)).select(*PAGE),
        f"{A} SELECT {', '.join(PAGE)} FROM actions {ORDER} LIMIT 50",
    ),
    "actions_page": (
        lambda s, d: ops.page(ops.history(model.actions(s, d), platform="twitter"), 100, 100).select(*PAGE),
        f"{A} SELECT {', '.join(PAGE)} FROM actions WHERE platform = 'twitter' {ORDER} LIMIT 100 OFFSET 100",
    ),
    "action_history": (
        lambda s, d: ops.history(model.actions(s, d), platform="reddit", agent_id=7).select(*PAGE),
        f"{A} SELECT {', '.join(PAGE)} FROM actions WHERE platform = 'reddit' AND agent_id = 7",
    ),
    "round_changes": (
        lambda s, d: _times(ops.round_changes(model.actions(s, d)), "timestamp"),
        f"""{A}, firsts AS (SELECT platform, round, arg_min(seq, ("timestamp", seq)) AS seq, min("timestamp") AS t FROM actions GROUP BY ALL)
        SELECT platform, round, lag(round) OVER (PARTITION BY platform ORDER BY round) AS previous_round, {TIME.format('t', '"timestamp"')}, seq FROM firsts""",
    ),
    "action_dedupe": (
        lambda s, d: ops.deduplicated(model.actions(s, d)).select("platform", "agent_id", "action_type", "seq", "copies"),
        f"""{A} SELECT platform, agent_id, action_type, min(seq) AS seq, count(*) AS copies FROM actions GROUP BY date_trunc('second', "timestamp"), platform, agent_id, action_type""",
    ),
    "platform_union": (
        lambda s, d: ops.history(model.actions(s, d), platform="twitter").unionByName(ops.history(model.actions(s, d), platform="reddit")).groupBy("platform").agg(F.count("*").alias("n"), F.sum("k").alias("k")),
        f"{A} SELECT platform, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM actions GROUP BY platform",
    ),
    "without_idle": (
        lambda s, d: ops.without_idle(model.actions(s, d), "view").groupBy("action_type").agg(F.count("*").alias("n")),
        f"{A} SELECT action_type, count(*) AS n FROM actions WHERE action_type <> 'view' GROUP BY 1",
    ),
    "memory_batches": (
        lambda s, d: ops.batch_texts(ops.arrival_batches(_episodes(_mapped(model.actions(s, d))))),
        f"""{A}, told AS (SELECT platform, seq, row_number() OVER (PARTITION BY platform ORDER BY seq) - 1 AS i, agent_name || ': ' ||
          CASE {STANDARD} WHEN 'LIKE_POST' THEN 'liked a post' WHEN 'SEARCH_POSTS' THEN 'searched posts' WHEN 'CREATE_POST' THEN 'posted: "item ' || k || '"'
          WHEN 'FOLLOW' THEN 'followed a user' ELSE 'did ' || {STANDARD} END AS text FROM actions)
        SELECT platform, CAST(i // 5 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, string_agg(text, chr(10) ORDER BY seq) AS text FROM told GROUP BY platform, i // 5""",
    ),
    "episode_text": (
        lambda s, d: _episodes(_mapped(model.actions(s, d))).select("seq", "text"),
        f"""{A} SELECT seq, agent_name || ': ' || CASE {STANDARD} WHEN 'LIKE_POST' THEN 'liked a post' WHEN 'SEARCH_POSTS' THEN 'searched posts' WHEN 'CREATE_POST' THEN 'posted: "item ' || k || '"'
          WHEN 'FOLLOW' THEN 'followed a user' ELSE 'did ' || {STANDARD} END AS text FROM actions""",
    ),
    "run_detail": (
        lambda s, d: (lambda a: a.join(F.broadcast(a.agg(F.max("round").alias("round"))), "round"))(model.actions(s, d)).select(*PAGE),
        f"{A} SELECT {', '.join(PAGE)} FROM actions WHERE round = (SELECT max(round) FROM actions)",
    ),
    "platforms_completed": (
        lambda s, d: ops.completion(model.actions(s, d).where("action_type = 'error' and round >= 600").select("platform"), model.actions(s, d)),
        f"""{A} SELECT count(*) AS platforms, coalesce(bool_and(ended), false) AS all_completed FROM
        (SELECT platform, bool_or(action_type = 'error' AND round >= 600) AS ended FROM actions GROUP BY platform)""",
    ),
    "tumbling_counts": (
        lambda s, d: ops.tumbling(model.actions(s, d), "6 hours").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "platform", "n", F.round("value", 2).alias("value")),
        f"""{A} SELECT {TIME.format("time_bucket(INTERVAL '6 hours', \"timestamp\", TIMESTAMP '2024-01-01')", 'start')}, platform, count(*) AS n, round(sum(value), 2) AS value FROM actions GROUP BY 1, 2""",
    ),
    "active_agents": (
        lambda s, d: rules.active_agents(model.agents(s, d), hour=20, round_number=20),
        f"""WITH {model.AGENTS_SQL}, r AS (SELECT agent_id, CAST(('0x' || substr(md5('20:' || agent_id), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
          CASE entity_type WHEN 'University' THEN 0.2 WHEN 'MediaOutlet' THEN 0.5 WHEN 'Professor' THEN 0.4 WHEN 'Student' THEN 0.8 ELSE 0.7 END AS level,
          CASE entity_type WHEN 'University' THEN 20 BETWEEN 9 AND 17 ELSE true END AS awake FROM agents)
        SELECT agent_id FROM r WHERE awake AND u < level ORDER BY u, agent_id LIMIT 30""",
    ),
    "round_clock": (
        lambda s, d: model.actions(s, d).select("round").distinct().select("round", *rules.clock("round", 45)),
        f"""{A} SELECT DISTINCT round, CAST((round * 45 // 60) % 24 AS BIGINT) AS hour, CAST(round * 45 // 1440 + 1 AS BIGINT) AS day,
        CASE WHEN (round * 45 // 60) % 24 IN (19, 20, 21, 22) THEN 1.5 WHEN (round * 45 // 60) % 24 IN (0, 1, 2, 3, 4, 5) THEN 0.05 ELSE 1.0 END AS multiplier FROM actions""",
    ),
    "total_rounds": (
        lambda s, d: model.agents(s, d).select("agent_id", rules.total_rounds(F.col("agent_id") % 97, F.lit(30), 100).alias("rounds"), rules.recommended_rounds(F.col("balance") / 10).alias("recommended"), rules.elapsed_label(F.col("agent_id"), F.lit(45)).alias("elapsed")),
        f"""WITH {model.AGENTS_SQL} SELECT agent_id, CAST(least(floor(agent_id % 97 * 60 / 30), 100) AS BIGINT) AS rounds, CAST(greatest(floor(balance / 10), 40) AS BIGINT) AS recommended,
        (agent_id * 45 // 60) || 'h ' || (agent_id * 45 % 60) || 'm' AS elapsed FROM agents""",
    ),
}
