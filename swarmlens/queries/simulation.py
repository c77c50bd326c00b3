"""Queries over agents, posts, interviews, configurations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens import sinks
from swarmlens.functions import rules
from swarmlens.operators import simulation as ops
from swarmlens.sources import model

G = "WITH " + model.AGENTS_SQL
I = "WITH " + model.INTERVIEWS_SQL  # noqa: E741
RULE_SQL = """ruled AS (SELECT *, CASE entity_type WHEN 'University' THEN 0.2 WHEN 'MediaOutlet' THEN 0.5 WHEN 'Professor' THEN 0.4 WHEN 'Student' THEN 0.8 ELSE 0.7 END AS activity_level,
  CASE entity_type WHEN 'University' THEN '9-17' WHEN 'MediaOutlet' THEN '7-23' WHEN 'Professor' THEN '8-21' WHEN 'Student' THEN '8-23' ELSE '9-23' END AS hours,
  CASE entity_type WHEN 'MediaOutlet' THEN 'observer' ELSE 'neutral' END AS stance,
  CASE entity_type WHEN 'University' THEN 3.0 WHEN 'MediaOutlet' THEN 2.5 WHEN 'Professor' THEN 2.0 WHEN 'Student' THEN 0.8 ELSE 1.0 END AS influence_weight FROM agents)"""


def _posts(s, d):
    """Orders as posts; every third is a repost of the order before it."""
    key = F.col("o_orderkey")
    return model.table(s, d, "orders").select(
        key.alias("post_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("order "), key).alias("content"), F.when(key % 3 == 0, key - 1).alias("original_post_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority")
    )


def _users(s, d):
    return model.table(s, d, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 2).alias("agent_id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("u"), "c_custkey").alias("user_name")
    )


def _acts(s, d):
    kinds = F.element_at(F.array(*map(F.lit, ["LIKE_POST", "REPOST", "FOLLOW", "QUOTE_POST", "TREND"])), (F.col("event_id") % 5 + 1).cast("int"))
    return model.table(s, d, "events").select(F.col("event_id").alias("seq"), kinds.alias("action_type"), F.col("event_id").alias("post_id"), F.col("user_id").alias("target_id"))


def _initial_posts(s, d):
    kinds = F.element_at(F.array(*map(F.lit, ["Student", "Official", "expert", "NGO", "Unheard"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return model.table(s, d, "orders").select(F.col("o_orderkey").alias("post_id"), kinds.alias("poster_type"))


def _profiles(s, d):
    return model.agents(s, d).select(
        F.col("agent_id").alias("user_id"), F.lower(F.replace("name", F.lit("#"), F.lit("_"))).alias("user_name"), "name",
        F.concat(F.lit("bio of\n"), "name", F.lit(" "), F.repeat(F.lit("x"), 140)).alias("bio"), F.concat(F.lit("persona of "), "name").alias("persona"),
        F.when(F.col("agent_id") % 2 == 0, F.col("agent_id") % 60 + 10).cast("int").alias("age"), F.when(F.col("agent_id") % 3 == 0, " Male ").alias("gender"),
        F.when(F.col("agent_id") % 5 == 0, "INTJ").alias("mbti"), F.lit(None).cast("string").alias("country"), F.lit(None).cast("int").alias("karma"), F.col("entity_type").alias("profession"),
    )


def _simulations(s, d):
    part = model.table(s, d, "part")
    return part.select(F.col("p_partkey").alias("simulation_id"), (F.col("p_partkey") % 7).alias("project_id"), F.col("p_size").alias("recommended"), F.col("p_retailprice").alias("created_at"))


def _reports(s, d):
    return model.table(s, d, "lineitem").select(F.col("l_partkey").alias("simulation_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int")).alias("report_id"), F.col("l_shipdate").alias("created_at"))


USERS_SQL = "users AS (SELECT c_custkey AS user_id, c_custkey * 2 AS agent_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, 'u' || c_custkey AS user_name FROM customer)"
POSTS_SQL = "posts AS (SELECT o_orderkey AS post_id, o_custkey AS user_id, 'order ' || o_orderkey AS content, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS original_post_id, o_orderdate AS created_at FROM orders)"
AUTHORED_SQL = "authored AS (SELECT post_id, content, coalesce(nullif(a.name, ''), nullif(u.name, ''), nullif(u.user_name, ''), '') AS author FROM posts LEFT JOIN users u USING (user_id) LEFT JOIN agents a ON a.agent_id = u.agent_id)"

QUERIES = {
    "posts_page": (
        lambda s, d: ops.paged(_posts(s, d), "created_at", "post_id", 50, 20).select("post_id", "user_id", "content"),
        f"WITH {POSTS_SQL} SELECT post_id, user_id, content FROM posts ORDER BY created_at DESC, post_id DESC LIMIT 50 OFFSET 20",
    ),
    "posts_with_author": (
        lambda s, d: ops.posts_with_author(_posts(s, d), _users(s, d), model.agents(s, d)),
        f"{G}, {POSTS_SQL}, {USERS_SQL}, {AUTHORED_SQL} SELECT * FROM authored",
    ),
    "action_enrichment": (
        lambda s, d: ops.enriched(_acts(s, d), _posts(s, d), _users(s, d), model.agents(s, d)).select("seq", "action_type", "post_content", "post_author", "target_name"),
        f"""{G}, {POSTS_SQL}, {USERS_SQL}, {AUTHORED_SQL}, acts AS (SELECT event_id AS seq, ['LIKE_POST', 'REPOST', 'FOLLOW', 'QUOTE_POST', 'TREND'][event_id % 5 + 1] AS action_type, event_id AS post_id, user_id AS target_id FROM events),
        about AS (SELECT acts.*, nullif(CASE WHEN action_type = 'LIKE_POST' THEN acts.post_id WHEN action_type IN ('REPOST', 'QUOTE_POST') THEN coalesce(p.original_post_id, acts.post_id) END, 0) AS about FROM acts LEFT JOIN posts p ON p.post_id = acts.post_id)
        SELECT seq, action_type, x.content AS post_content, x.author AS post_author, coalesce(nullif(u.name, ''), u.user_name) AS target_name
        FROM about LEFT JOIN authored x ON x.post_id = about LEFT JOIN users u ON action_type = 'FOLLOW' AND u.user_id = nullif(target_id, 0)""",
    ),
    "named_actions": (
        lambda s, d: ops.named_actions(model.actions(s, d), model.agents(s, d).where("agent_id % 3 = 0")).groupBy("agent_name").agg(F.count("*").alias("n")),
        f"WITH {model.ACTIONS_SQL}, {model.AGENTS_SQL} SELECT coalesce(g.name, 'Agent_' || a.agent_id) AS agent_name, count(*) AS n FROM actions a LEFT JOIN agents g ON g.agent_id = a.agent_id AND g.agent_id % 3 = 0 GROUP BY 1",
    ),
    "interview_history": (
        lambda s, d: ops.interview_history(model.interviews(s, d), 40).select("conv_id", "turn", "platform", F.md5("response").alias("response")),
        f"""{I}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY conv_id DESC, turn DESC) AS i FROM interviews)
        SELECT conv_id, turn, platform, md5(response) AS response FROM r WHERE i <= 40 ORDER BY conv_id DESC, turn DESC LIMIT 40""",
    ),
    "latest_interview": (
        lambda s, d: ops.latest_interview(model.interviews(s, d)).select("platform", "agent_id", "conv_id", "turn", F.md5("response").alias("response")),
        f"""{I}, r AS (SELECT *, row_number() OVER (PARTITION BY platform, agent_id ORDER BY conv_id DESC, turn DESC) AS i FROM interviews)
        SELECT platform, agent_id, conv_id, turn, md5(response) AS response FROM r WHERE i = 1""",
    ),
    "survey_answers": (
        lambda s, d: ops.answers(model.agents(s, d), ops.latest_interview(model.interviews(s, d))).select("agent_id", F.md5("answer").alias("answer")),
        f"""WITH {model.INTERVIEWS_SQL}, {model.AGENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY platform, agent_id ORDER BY conv_id DESC, turn DESC) AS i FROM interviews)
        SELECT g.agent_id, md5(coalesce(max(r.response) FILTER (WHERE platform = 'reddit'), max(r.response) FILTER (WHERE platform = 'twitter'), '(no answer)')) AS answer
        FROM agents g LEFT JOIN r ON r.agent_id = g.agent_id AND r.i = 1 GROUP BY g.agent_id""",
    ),
    "chat_window": (
        lambda s, d: ops.last_turns(model.table(s, d, "conversations"), 3).select("conv_id", "turn", "role"),
        "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 3",
    ),
    "agent_batches": (
        lambda s, d: ops.batched(model.agents(s, d), "agent_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("agent_id").alias("first")),
        f"{G} SELECT CAST(agent_id // 15 AS BIGINT) AS batch, count(*) AS n, min(agent_id) AS first FROM agents GROUP BY 1",
    ),
    "poster_assignment": (
        lambda s, d: ops.poster_assignment(_initial_posts(s, d), model.agents(s, d)),
        f"""{G}, posts AS (SELECT o_orderkey AS post_id, ['student', 'official', 'expert', 'ngo', 'unheard'][o_orderkey % 5 + 1] AS poster_type FROM orders),
        mapped AS (SELECT *, CASE poster_type WHEN 'student' THEN 'student' WHEN 'official' THEN 'university' WHEN 'expert' THEN 'professor' WHEN 'ngo' THEN 'company' END AS kind FROM posts),
        turns AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY post_id) - 1 AS i FROM mapped),
        ordinals AS (SELECT lower(entity_type) AS kind, agent_id, row_number() OVER (PARTITION BY entity_type ORDER BY agent_id) - 1 AS i, count(*) OVER (PARTITION BY entity_type) AS n FROM agents)
        SELECT post_id, poster_type, coalesce(o.agent_id, (SELECT min(agent_id) FROM agents WHERE entity_type = 'University')) AS agent_id FROM turns t LEFT JOIN ordinals o ON o.kind = t.kind AND o.i = t.i % o.n""",
    ),
    "agent_config_rules": (
        lambda s, d: rules.agent_rules(model.agents(s, d)).select("agent_id", "activity_level", F.concat_ws("-", F.array_min("active_hours"), F.array_max("active_hours")).alias("hours"), "stance", "influence_weight"),
        f"{G}, {RULE_SQL} SELECT agent_id, activity_level, hours, stance, influence_weight FROM ruled",
    ),
    "merged_config": (
        lambda s, d: ops.merged_config(model.agents(s, d), model.agents(s, d).where("agent_id % 5 = 0").select("agent_id", F.lit(0.99).alias("activity_level"), F.lit(None).cast("string").alias("stance")), ["activity_level", "stance"]).select("agent_id", "activity_level", "stance"),
        f"{G}, {RULE_SQL} SELECT agent_id, CASE WHEN agent_id % 5 = 0 THEN 0.99 ELSE activity_level END AS activity_level, stance FROM ruled",
    ),
    "highest_influence": (
        lambda s, d: rules.agent_rules(model.agents(s, d)).agg(F.max_by("agent_id", F.struct("influence_weight", -F.col("agent_id"))).alias("agent_id")),
        f"{G}, {RULE_SQL} SELECT agent_id FROM ruled ORDER BY influence_weight DESC, agent_id LIMIT 1",
    ),
    "time_config": (
        lambda s, d: model.agents(s, d).select("agent_id", *rules.time_config(F.col("agent_id") + 1, F.lit(50).cast("long"), F.col("agent_id") * 2)),
        f"""{G}, t AS (SELECT agent_id, least(greatest(agent_id * 2, 1), agent_id + 1) AS most, least(50, agent_id + 1) AS few FROM agents)
        SELECT agent_id, CASE WHEN few >= most THEN greatest(1, most // 2) ELSE few END AS agents_per_hour_min, most AS agents_per_hour_max FROM t""",
    ),
    "entity_classes": (
        lambda s, d: model.agents(s, d).groupBy(rules.is_individual(F.col("entity_type")).alias("individual"), rules.is_group(F.col("entity_type")).alias("collective")).agg(F.count("*").alias("n")),
        f"{G} SELECT entity_type IN ('Student', 'Professor', 'Person') AS individual, entity_type IN ('University', 'MediaOutlet', 'Company') AS collective, count(*) AS n FROM agents GROUP BY ALL",
    ),
    "latest_report": (
        lambda s, d: ops.latest_reports(_reports(s, d)).select("simulation_id", "report_id"),
        """WITH r AS (SELECT l_partkey AS simulation_id, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER)) AS report_id, l_shipdate AS created_at FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY simulation_id ORDER BY created_at DESC, report_id DESC) AS i FROM r) SELECT simulation_id, report_id FROM o WHERE i = 1""",
    ),
    "simulation_history": (
        lambda s, d: ops.simulation_history(
            _simulations(s, d), _simulations(s, d).where("simulation_id % 2 = 0").select("simulation_id", (F.col("simulation_id") % 4).alias("total_rounds")),
            model.table(s, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project")), _reports(s, d),
        ).select("simulation_id", "total_rounds", "project", "report_id"),
        """WITH r AS (SELECT l_partkey AS simulation_id, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER)) AS report_id, l_shipdate AS created_at FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY simulation_id ORDER BY created_at DESC, report_id DESC) AS i FROM r)
        SELECT p_partkey AS simulation_id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN nullif(p_partkey % 4, 0) END, p_size) AS total_rounds, n_name AS project, o.report_id
        FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 7 LEFT JOIN o ON o.simulation_id = p_partkey AND o.i = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 20""",
    ),
    "reddit_profiles": (
        lambda s, d: sinks.reddit_profiles(_profiles(s, d)).select("user_id", "username", "bio", "karma", "age", "gender", "mbti", "country"),
        f"""{G} SELECT agent_id AS user_id, lower(replace(name, '#', '_')) AS username, left('bio of' || chr(10) || name || ' ' || repeat('x', 140), 150) AS bio, 1000 AS karma,
        CAST(CASE WHEN agent_id % 2 = 0 THEN agent_id % 60 + 10 ELSE 30 END AS INTEGER) AS age, CASE WHEN agent_id % 3 = 0 THEN 'male' ELSE 'other' END AS gender, CASE WHEN agent_id % 5 = 0 THEN 'INTJ' ELSE 'ISTJ' END AS mbti, '中国' AS country FROM agents""",
    ),
    "twitter_profiles": (
        lambda s, d: sinks.twitter_profiles(_profiles(s, d)),
        f"""{G} SELECT row_number() OVER (ORDER BY agent_id) - 1 AS user_id, name, lower(replace(name, '#', '_')) AS username,
        'bio of ' || name || ' ' || repeat('x', 140) || ' persona of ' || name AS user_char, 'bio of ' || name || ' ' || repeat('x', 140) AS description FROM agents""",
    ),
}
