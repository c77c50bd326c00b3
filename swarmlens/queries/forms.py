"""Queries over text forms, repairs, rules and tools, with inputs that reach every branch."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.functions import render, repair, rules, text
from swarmlens.operators import actions, graph, reports
from swarmlens.operators import simulation as ops
from swarmlens.plans import retrieval, tools
from swarmlens.queries.retrieval import _hits
from swarmlens.queries.simulation import _posts, _users
from swarmlens.sources import model

A = "WITH " + model.ACTIONS_SQL
N = "WITH " + model.NODES_SQL
NE = f"WITH {model.NODES_SQL}, {model.EDGES_SQL}"
KINDS = ("CREATE_POST", "LIKE_POST", "DISLIKE_POST", "REPOST", "QUOTE_POST", "FOLLOW", "CREATE_COMMENT", "LIKE_COMMENT", "DISLIKE_COMMENT", "SEARCH_POSTS", "SEARCH_USER", "MUTE", "TREND")
KIND_SQL = f"{list(KINDS)}[event_id % {len(KINDS)} + 1]"


def _kind():
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int"))


def _episodes(s, d) -> DataFrame:
    """Every kind of action, with all it can say and, every third, with nothing."""
    rows = model.table(s, d, "events").select("event_id", F.concat(F.lit("U"), "user_id").alias("name"), _kind().alias("kind"))
    said = lambda x: F.concat(F.lit(f"{x} "), F.col("event_id").cast("string"))
    keys = ("content", "post_content", "post_author_name", "original_content", "original_author_name", "comment_content", "comment_author_name", "quote_content", "target_user_name", "query")
    kept = {k: F.when(F.col("kind").isin("LIKE_COMMENT", "DISLIKE_COMMENT") if k.startswith("comment") else ~F.col("kind").isin("LIKE_COMMENT", "DISLIKE_COMMENT"), said(k.split("_")[0])) for k in keys}
    args = F.when(F.col("event_id") % 3 == 0, F.create_map().cast("map<string, string>")).otherwise(F.create_map(*(x for k, v in kept.items() for x in (F.lit(k), v))))
    return rows.select("event_id", text.episode("name", F.col("kind"), args).alias("text"))


EPISODE_SQL = f"""WITH e AS (SELECT event_id, 'U' || user_id AS name, {KIND_SQL} AS kind, ' ' || event_id AS i, event_id % 3 = 0 AS bare FROM events)
SELECT event_id, name || ': ' || CASE kind
  WHEN 'CREATE_POST' THEN CASE WHEN bare THEN 'posted' ELSE 'posted: "content' || i || '"' END
  WHEN 'LIKE_POST' THEN CASE WHEN bare THEN 'liked a post' ELSE 'liked post' || i || '''s post: "post' || i || '"' END
  WHEN 'DISLIKE_POST' THEN CASE WHEN bare THEN 'disliked a post' ELSE 'disliked post' || i || '''s post: "post' || i || '"' END
  WHEN 'REPOST' THEN CASE WHEN bare THEN 'reposted a post' ELSE 'reposted post' || i || '''s post: "post' || i || '"' END
  WHEN 'QUOTE_POST' THEN CASE WHEN bare THEN 'quoted a post' ELSE 'quoted post' || i || '''s post: "post' || i || '", saying "quote' || i || '"' END
  WHEN 'FOLLOW' THEN CASE WHEN bare THEN 'followed a user' ELSE 'followed target' || i END
  WHEN 'CREATE_COMMENT' THEN CASE WHEN bare THEN 'commented' ELSE 'commented: "content' || i || '"' END
  WHEN 'LIKE_COMMENT' THEN CASE WHEN bare THEN 'liked a comment' ELSE 'liked comment' || i || '''s comment: "comment' || i || '"' END
  WHEN 'DISLIKE_COMMENT' THEN CASE WHEN bare THEN 'disliked a comment' ELSE 'disliked comment' || i || '''s comment: "comment' || i || '"' END
  WHEN 'SEARCH_POSTS' THEN CASE WHEN bare THEN 'searched posts' ELSE 'searched posts for "query' || i || '"' END
  WHEN 'SEARCH_USER' THEN CASE WHEN bare THEN 'searched users' ELSE 'searched users for "query' || i || '"' END
  WHEN 'MUTE' THEN CASE WHEN bare THEN 'muted a user' ELSE 'muted target' || i END
  ELSE 'did ' || kind END AS text FROM e"""


COMMENTS_SQL = "comments AS (SELECT 10 * l_orderkey + l_linenumber AS comment_id, min(l_orderkey) AS post_id, min(l_suppkey) AS user_id, min('line ' || l_linenumber) AS content FROM lineitem GROUP BY 1)"
USERS_SQL = "users AS (SELECT c_custkey AS user_id, c_custkey * 2 AS agent_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, 'u' || c_custkey AS user_name FROM customer)"
PEOPLE_SQL = f"{model.AGENTS_SQL}, {USERS_SQL}, people AS (SELECT u.user_id, coalesce(nullif(a.name, ''), nullif(u.name, ''), nullif(u.user_name, ''), '') AS author FROM users u LEFT JOIN agents a ON a.agent_id = u.agent_id)"


def _comments(s, d) -> DataFrame:
    """Lines of orders as comments on them; of lines of one number the least supplier is the user."""
    rows = model.table(s, d, "lineitem").groupBy((10 * F.col("l_orderkey") + F.col("l_linenumber")).alias("comment_id"))
    return rows.agg(F.min("l_orderkey").alias("post_id"), F.min("l_suppkey").alias("user_id"), F.min(F.concat(F.lit("line "), "l_linenumber")).alias("content"))


def _comment_actions(s, d) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["LIKE_COMMENT", "DISLIKE_COMMENT", "CREATE_COMMENT", "TREND"])), (F.col("event_id") % 4 + 1).cast("int"))
    acts = model.table(s, d, "events").select(F.col("event_id").alias("seq"), kinds.alias("action_type"), (F.col("event_id") % 100).alias("post_id"), F.col("user_id").alias("target_id"), (10 * (F.col("event_id") % 100) + F.col("event_id") % 3).alias("comment_id"))
    return ops.enriched(acts, _posts(s, d), _users(s, d), model.agents(s, d), _comments(s, d)).select("seq", "action_type", "post_content", "post_author", "comment_content", "comment_author")


# Model output as it comes


def _responses(s, d) -> DataFrame:
    """Names in the shapes that models wrap answers in."""
    return model.table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_partkey") % 5).alias("shape"))


def _cleaned(s, d) -> DataFrame:
    rows = _responses(s, d)
    name = F.col("name")
    raw = F.when(F.col("shape") == 0, F.concat(F.lit("<think>so\n"), name, F.lit("</think> "), name)).when(F.col("shape") == 1, F.concat(F.lit("```json\n"), name, F.lit("\n```"))).otherwise(F.concat(F.lit("## "), name, F.lit("\n**bold** 【x】\nQuestion 2: yes")))
    wrapped = F.when(F.col("shape") == 0, F.concat(F.lit('{"tool_name": "t", "arguments": {"content": "'), name, F.lit('"}}'))).when(F.col("shape") == 1, F.concat(F.lit('{"tool_name": "t", "content": "'), name)).otherwise(name)
    final = F.when(F.col("shape") == 0, F.concat(F.lit("x <final_answer> "), name, F.lit(" </final_answer> y"))).when(F.col("shape") == 1, F.concat(F.lit("thinking. Final Answer: "), name)).when(F.col("shape") == 2, F.concat(F.lit("intro\n# "), name)).otherwise(name)
    return rows.select("p_partkey", text.without_fences(text.without_thinking(raw)).alias("bare"), render.cleaned_response(raw).alias("cleaned"), render.unwrapped(wrapped).alias("inner"), render.final_answer(final).alias("final"))


CLEANED_SQL = """WITH r AS (SELECT p_partkey, p_name AS name, p_partkey % 5 AS shape FROM part)
SELECT p_partkey, CASE WHEN shape <= 1 THEN name ELSE '## ' || name || chr(10) || '**bold** 【x】' || chr(10) || 'Question 2: yes' END AS bare,
  CASE shape WHEN 0 THEN '<think>so' || chr(10) || name || '</think> ' || name WHEN 1 THEN 'json' || chr(10) || name || chr(10) ELSE name || chr(10) || 'bold x' || chr(10) || 'yes' END AS cleaned,
  name AS inner, CASE WHEN shape = 2 THEN '# ' || name ELSE name END AS final FROM r"""


def _quotes(s, d) -> DataFrame:
    name = F.col("p_name")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("“, "), name, F.lit(" and more”"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("问题1 "), name)).when(F.col("p_partkey") % 4 == 2, F.repeat(F.concat(name, F.lit(" ")), 40)).otherwise(F.lit("tiny"))
    return model.table(s, d, "part").select("p_partkey", render.cleaned_quote(raw).alias("quote"))


QUOTES_SQL = """WITH r AS (SELECT p_partkey, p_partkey % 4 AS shape, p_name AS name, rtrim(repeat(p_name || ' ', 40)) AS long FROM part)
SELECT p_partkey, CASE shape WHEN 0 THEN name || ' and more' WHEN 2 THEN CASE WHEN length(long) <= 150 THEN long ELSE left(long, 147) || '...' END END AS quote FROM r"""


def _tool_calls(s, d) -> DataFrame:
    @F.udf("array<struct<name: string, parameters: string>>", useArrow=True)
    def calls(response: str):
        return [(c["name"], json.dumps(c["parameters"])) for c in repair.tool_calls(response)]

    call = F.concat(F.lit('{"name": "quick_search", "parameters": {"query": "'), "p_name", F.lit('"}}'))
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("first <tool_call>"), call, F.lit("</tool_call> then <tool_call>{bad}</tool_call>"))).when(F.col("p_partkey") % 4 == 1, call)
    raw = raw.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('{"name": "unheard_of", "parameters": {"query": "'), "p_name", F.lit('"}}'))).otherwise(F.concat(F.lit("so: "), F.lit('{"tool": "panorama_search", "params": {}}')))
    return model.table(s, d, "part").select("p_partkey", F.explode_outer(calls(raw)).alias("c")).select("p_partkey", "c.name", "c.parameters")


def _json_shapes(s, d) -> DataFrame:
    name = F.col("p_name")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('noise {"b": [1, {"a": "'), name)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"b": "'), name, F.lit('\n"} tail'))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('{"b": [1, 2,'))).otherwise(name)
    return model.table(s, d, "part").select("p_partkey", repair.repaired_json(raw).alias("json"))


def _salvaged(s, d) -> DataFrame:
    @F.udf("struct<bio: string, persona: string, mended: boolean>", useArrow=True)
    def profile(raw: str, name: str, kind: str):
        found = repair.salvaged_profile(raw, name, kind)
        return found.get("bio"), found.get("persona"), bool(found.get("_fixed"))

    name = F.col("p_name")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"bio": "'), name, F.lit('", "persona": "P'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"bio": "'), name, F.lit('", oops')))
    return model.table(s, d, "part").select("p_partkey", profile(raw, name, F.col("p_brand")).alias("x")).select("p_partkey", "x.*")


# Rendered results and back


def _facts_back(s, d) -> DataFrame:
    per_supplier = model.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("ships by "), "l_returnflag"))).alias("facts"))
    shown = per_supplier.withColumn("text", render.facts_text(F.concat(F.lit("supplier "), "l_suppkey"), F.col("facts")))
    return shown.select("l_suppkey", "text", F.array_join(render.parsed_facts(F.col("text")), "|").alias("facts"))


def _reports_back(s, d) -> DataFrame:
    """Composite results of every region, rendered for a reader and parsed again."""
    out = []
    rows = model.table(s, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for region in sorted({r["n_regionkey"] for r in rows}):
        names = [r["n_name"] for r in rows if r["n_regionkey"] == region]
        insight = render.parsed_insight(render.insight_text(f"region {region}", names, [(n, "Nation") for n in names], [f"{n} --[PART_OF]--> {region}" for n in names]))
        panorama = render.parsed_panorama(render.panorama_text(f"region {region}", names[:2], names[2:], (2, len(names) - 2)))
        talk = render.parsed_interview(render.interview_text(names[0], "Nation", "a bio", "how?", f"like {region}", names[1:]))
        out.append((region, insight["query"], "|".join(insight["facts"]), "|".join(f"{n}:{t}" for n, t in insight["entities"]), "|".join(insight["chains"]), "|".join(panorama["active"]), "|".join(panorama["historical"]), panorama["counts"][1], talk["agent"], talk["answer"], "|".join(talk["quotes"])))
    return s.createDataFrame(out, "region long, query string, facts string, entities string, chains string, active string, historical string, n_historical long, agent string, answer string, quotes string")


REPORTS_SQL = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT CAST(n_regionkey AS BIGINT) AS region, 'region ' || n_regionkey AS query, string_agg(n_name, '|' ORDER BY i) AS facts, string_agg(n_name || ':Nation', '|' ORDER BY i) AS entities,
  string_agg(n_name || ' --[PART_OF]--> ' || n_regionkey, '|' ORDER BY i) AS chains, string_agg(n_name, '|' ORDER BY i) FILTER (WHERE i <= 2) AS active, coalesce(string_agg(n_name, '|' ORDER BY i) FILTER (WHERE i > 2), '') AS historical,
  CAST(count(*) - 2 AS BIGINT) AS n_historical, arg_min(n_name, i) AS agent, 'like ' || n_regionkey AS answer, coalesce(string_agg(n_name, '|' ORDER BY i) FILTER (WHERE i > 1), '') AS quotes FROM n GROUP BY n_regionkey"""


def _contexts(s, d) -> DataFrame:
    rows = model.table(s, d, "nation").withColumn("facts", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit(" exists")))).otherwise(F.array().cast("array<string>")))
    attributes = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))
    entity = render.entity_context(F.col("n_name"), attributes, F.col("facts"), F.array(F.lit("sea")))
    return rows.select("n_nationkey", entity.alias("entity"), render.config_context("why", F.col("n_name"), F.repeat(F.lit("d"), 100), most=90, reserve=20).alias("config"))


def _interview_info(s, d) -> DataFrame:
    """Interview records: the fields of a JSON object, or the whole text."""
    info = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("said "), "event_id")).otherwise(F.to_json(F.struct(F.concat(F.lit("p"), "event_id").alias("prompt"), F.concat(F.lit("r"), "event_id").alias("response"))))
    rows = model.table(s, d, "events").select("event_id", info.alias("info"))
    return rows.select("event_id", F.get_json_object("info", "$.prompt").alias("prompt"), F.coalesce(F.get_json_object("info", "$.response"), F.col("info")).alias("response"))


def _ontology(s, d) -> DataFrame:
    """The types of each brand, cut to the limit with the fallbacks in place."""
    kinds = model.table(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.struct(F.when(F.col("p_size") % 9 == 0, "Person").otherwise(F.concat(F.lit("T"), (F.col("p_size") % 15).cast("string"))).alias("name"), F.repeat(F.lit("long "), 25).alias("description")))).alias("t"))
    types = kinds.select("p_brand", F.posexplode(reports.with_fallback_types(F.col("t"))).alias("i", "t"))
    return types.select("p_brand", "i", "t.name", F.col("t.description").alias("description"))


ONTOLOGY_SQL = """WITH k AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 9 = 0 THEN 'Person' ELSE 'T' || (p_size % 15) END AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name) - 1 AS i, max(CASE WHEN name = 'Person' THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS has FROM k),
kept AS (SELECT * FROM r WHERE i < 9 - (1 - has)), n AS (SELECT p_brand, count(*) AS n, max(has) AS has FROM kept GROUP BY 1)
SELECT p_brand, CAST(i AS INTEGER) AS i, name, left(repeat('long ', 25), 97) || '...' AS description FROM kept
UNION ALL SELECT p_brand, CAST(n AS INTEGER), 'Person', 'Any person of no other type' FROM n WHERE has = 0
UNION ALL SELECT p_brand, CAST(n + (1 - has) AS INTEGER), 'Organization', 'Any organization of no other type' FROM n"""


def _tool_texts(s, d) -> DataFrame:
    nodes, edges = model.nodes(s, d), model.edges(s, d)
    asked = [
        ("get_graph_statistics", {}), ("get_entities_by_type", {"entity_type": "Nation"}), ("get_entities_by_type", {}), ("no_such_tool", {}),
        ("search_graph", {"query": "part of region", "limit": 5}), ("get_entity_summary", {"entity_name": "nation_3"}), ("panorama_search", {"query": "region", "limit": 3, "include_expired": False}),
    ]
    rows = [tools.tool_row(name, p, nodes, edges).select(F.lit(k).alias("k"), F.lit(name).alias("tool"), "text") for k, (name, p) in enumerate(asked)]
    return reduce(DataFrame.unionByName, rows)


TOOLS_SQL = f"""{NE}, scored AS (SELECT id, fact, CASE WHEN contains(lower(fact), 'part of region') THEN 100 ELSE CASE WHEN contains(lower(fact), 'part') THEN 10 ELSE 0 END + CASE WHEN contains(lower(fact), 'of') THEN 10 ELSE 0 END + CASE WHEN contains(lower(fact), 'region') THEN 10 ELSE 0 END END
  + CASE WHEN contains(lower(name), 'part') THEN 10 ELSE 0 END + CASE WHEN contains(lower(name), 'of') THEN 10 ELSE 0 END AS score FROM edges),
  top AS (SELECT fact, row_number() OVER (ORDER BY score DESC, id) AS i FROM scored WHERE score > 0),
  pan AS (SELECT fact, row_number() OVER (ORDER BY CASE WHEN contains(lower(fact), 'region') THEN 110 ELSE 0 END DESC, id) AS i FROM edges WHERE expired_at IS NULL AND invalid_at IS NULL AND fact <> ''),
  counts AS (SELECT count(*) FILTER (WHERE expired_at IS NULL AND invalid_at IS NULL) AS active, count(*) FILTER (WHERE expired_at IS NOT NULL OR invalid_at IS NOT NULL) AS historical FROM edges),
  one AS (SELECT min(id) AS id FROM nodes WHERE lower(name) = 'nation_3')
SELECT 0 AS k, 'get_graph_statistics' AS tool, 'nodes: ' || (SELECT count(*) FROM nodes) || ', edges: ' || (SELECT count(*) FROM edges) || ', labels: ' || (SELECT count(DISTINCT l) FROM (SELECT unnest(labels) AS l FROM nodes) WHERE l NOT IN ('Entity', 'Node')) AS text
UNION ALL SELECT 1, 'get_entities_by_type', (SELECT string_agg(name, chr(10) ORDER BY id) FROM nodes WHERE list_contains(labels, 'Nation'))
UNION ALL SELECT 2, 'get_entities_by_type', 'get_entities_by_type needs the parameter ''entity_type'''
UNION ALL SELECT 3, 'no_such_tool', 'unknown tool: no_such_tool; there are quick_search, panorama_search, insight_forge, get_graph_statistics, get_entities_by_type, get_entity_summary'
UNION ALL SELECT 4, 'search_graph', 'Query: part of region' || chr(10) || 'Found: 5' || chr(10) || chr(10) || '### Facts' || chr(10) || (SELECT string_agg(i || '. ' || fact, chr(10) ORDER BY i) FROM top WHERE i <= 5)
UNION ALL SELECT 5, 'get_entity_summary', (SELECT coalesce(string_agg(fact, chr(10) ORDER BY edges.id), '') FROM edges, one WHERE source = one.id OR target = one.id)
UNION ALL SELECT 6, 'panorama_search', '## Panorama' || chr(10) || 'Query: region' || chr(10) || chr(10) || '### Figures' || chr(10) || '- active: ' || (SELECT active FROM counts) || chr(10) || '- historical: ' || (SELECT historical FROM counts) || chr(10) || chr(10) || '### Active facts' || chr(10) || (SELECT string_agg(i || '. "' || fact || '"', chr(10) ORDER BY i) FROM pan WHERE i <= 3)"""


def _model_answers(s, d) -> DataFrame:
    """A model that fails on some prompts: those have no answer, their rows stay."""

    def shout(prompt: str) -> str:
        if prompt.endswith("7"):
            raise ValueError(prompt)
        return prompt.upper()

    return tools.with_model(model.agents(s, d).select("agent_id", F.concat(F.lit("ask "), F.lower("name")).alias("prompt")), "prompt", shout)


def _prepared(s, d) -> DataFrame:
    profiles, configs = tools.prepared(model.nodes(s, d), ["Nation", "Supplier"])
    merged = profiles.join(configs.select("agent_id", "activity_level", "stance"), F.col("id") == F.col("agent_id"))
    return merged.select("id", "user_name", "bio", "profession", "activity_level", "stance")


def _interview_plan(s, d) -> DataFrame:
    plan = tools.interview_plan(model.agents(s, d), ops.latest_interview(model.interviews(s, d)))
    return plan.select("agent_id", F.md5("answer").alias("answer"))


def _snapshot(s, d) -> DataFrame:
    simulations = model.table(s, d, "region").select(F.col("r_regionkey").alias("simulation_id"), F.lit(9).alias("expected"), F.when(F.col("r_regionkey") % 2 == 0, "preparing").otherwise("ready").alias("status"))
    profiles = model.table(s, d, "nation").where("n_regionkey <> 1").select(F.col("n_regionkey").alias("simulation_id"))
    return reports.snapshot(profiles, simulations)


def _tasks(s, d) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["completed", "failed", "running"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return model.table(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.lower("o_orderstatus").alias("task_type"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


NOW = "TIMESTAMP '1996-01-01'"


def _memory_stats(s, d) -> DataFrame:
    batched = actions.arrival_batches(model.actions(s, d).withColumn("text", F.col("agent_name")))
    return actions.update_stats(batched)


QUERIES = {
    "episode_kinds": (_episodes, EPISODE_SQL),
    "comments_with_author": (
        lambda s, d: ops.comments_with_author(_comments(s, d), _users(s, d), model.agents(s, d)),
        f"WITH {PEOPLE_SQL}, {COMMENTS_SQL} SELECT comment_id, post_id, content, author FROM comments LEFT JOIN people USING (user_id)",
    ),
    "comment_enrichment": (
        lambda s, d: _comment_actions(s, d),
        f"""WITH {PEOPLE_SQL}, {COMMENTS_SQL}, acts AS (SELECT event_id AS seq, ['LIKE_COMMENT', 'DISLIKE_COMMENT', 'CREATE_COMMENT', 'TREND'][event_id % 4 + 1] AS action_type, event_id % 100 AS post_id, 10 * (event_id % 100) + event_id % 3 AS comment_id FROM events)
        SELECT seq, action_type, CASE WHEN action_type = 'CREATE_COMMENT' THEN 'order ' || o_orderkey END AS post_content, CASE WHEN action_type = 'CREATE_COMMENT' THEN p.author END AS post_author,
          CASE WHEN action_type IN ('LIKE_COMMENT', 'DISLIKE_COMMENT') THEN c.content END AS comment_content, CASE WHEN action_type IN ('LIKE_COMMENT', 'DISLIKE_COMMENT') THEN q.author END AS comment_author
        FROM acts LEFT JOIN orders ON o_orderkey = nullif(acts.post_id, 0) LEFT JOIN people p ON p.user_id = o_custkey LEFT JOIN comments c ON c.comment_id = nullif(acts.comment_id, 0) LEFT JOIN people q ON q.user_id = c.user_id""",
    ),
    "cleaned_responses": (_cleaned, CLEANED_SQL),
    "cleaned_quotes": (_quotes, QUOTES_SQL),
    "tool_calls": (
        _tool_calls,
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN 'panorama_search' ELSE 'quick_search' END AS name, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN '{}' ELSE '{"query": "' || p_name || '"}' END AS parameters FROM part""",
    ),
    "json_closed": (
        _json_shapes,
        """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"b": [1, {"a": "' || p_name || '"}]}' WHEN 1 THEN '{"b": "' || p_name || ' "}' WHEN 2 THEN '{"b": [1, 2]}' END AS json FROM part""",
    ),
    "salvaged_profiles": (
        _salvaged,
        """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE p_name || ', ' || p_brand END AS bio, CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE p_name || ' is a ' || p_brand || '.' END AS persona, p_partkey % 3 > 0 AS mended FROM part""",
    ),
    "facts_read_back": (
        _facts_back,
        """WITH f AS (SELECT DISTINCT l_suppkey, 'ships by ' || l_returnflag AS fact FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY fact) AS i FROM f)
        SELECT l_suppkey, 'Query: supplier ' || l_suppkey || chr(10) || 'Found: ' || count(*) || chr(10) || chr(10) || '### Facts' || chr(10) || string_agg(i || '. ' || fact, chr(10) ORDER BY i) AS text, string_agg(fact, '|' ORDER BY i) AS facts FROM n GROUP BY l_suppkey""",
    ),
    "reports_read_back": (_reports_back, REPORTS_SQL),
    "contexts": (
        _contexts,
        """WITH c AS (SELECT *, '## Requirement' || chr(10) || 'why' || chr(10) || chr(10) || '## Entities' || chr(10) || n_name AS head FROM nation)
        SELECT n_nationkey, '## ' || n_name || chr(10) || chr(10) || '### Attributes' || chr(10) || '- region: ' || n_regionkey || chr(10) || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '### Facts' || chr(10) || '- ' || n_name || ' exists' || chr(10) || chr(10) ELSE '' END || '### Neighbours' || chr(10) || '- sea' AS entity,
        head || chr(10) || chr(10) || '## Document' || chr(10) || repeat('d', CAST(greatest(0, 70 - length(head)) AS BIGINT)) AS config FROM c""",
    ),
    "platform_labels": (
        lambda s, d: model.table(s, d, "events").select(render.action_label(_kind()).alias("label")).groupBy("label").agg(F.count("*").alias("n")),
        f"""SELECT CASE WHEN kind LIKE 'LIKE%' THEN 'LIKE' WHEN kind LIKE 'DISLIKE%' THEN 'DISLIKE' WHEN kind LIKE 'SEARCH%' THEN 'SEARCH' WHEN kind = 'CREATE_POST' THEN 'POST' WHEN kind = 'CREATE_COMMENT' THEN 'COMMENT' WHEN kind = 'QUOTE_POST' THEN 'QUOTE' ELSE kind END AS label, count(*) AS n
        FROM (SELECT {KIND_SQL} AS kind FROM events) GROUP BY 1""",
    ),
    "upload_filter": (
        lambda s, d: model.table(s, d, "pages").select("page_id", text.allowed_file(F.concat(F.lit("file"), F.element_at(F.array(*map(F.lit, [".PDF", ".md", ".exe", "", ".Markdown", ".txt.gz"])), (F.col("page_id") % 6 + 1).cast("int")))).alias("allowed")),
        "SELECT page_id, page_id % 6 IN (0, 1, 4) AS allowed FROM pages",
    ),
    "interview_info": (
        _interview_info,
        "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'p' || event_id END AS prompt, CASE WHEN event_id % 3 <> 0 THEN 'r' || event_id ELSE 'said ' || event_id END AS response FROM events",
    ),
    "episode_lists": (
        lambda s, d: model.table(s, d, "events").select("event_id", F.size(rules.episode_ids(F.when(F.col("event_id") % 3 == 0, F.lit('["a", "b"]')).when(F.col("event_id") % 3 == 1, F.lit('[{"uuid": "a"}, {"uuid_": "b"}, {"x": 1}]')).otherwise(F.lit('"one"')))).alias("n")),
        "SELECT event_id, CAST(CASE WHEN event_id % 3 < 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM events",
    ),
    "ontology_types": (_ontology, ONTOLOGY_SQL),
    "edge_types_valid": (
        lambda s, d: reports.valid_edge_types(model.table(s, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.collect_set(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("source_targets"))).select("name", F.size("source_targets").alias("n")),
        "SELECT p_type AS name, CAST(count(DISTINCT p_brand) AS INTEGER) AS n FROM part WHERE p_size > 25 GROUP BY 1 ORDER BY 1 LIMIT 10",
    ),
    "tool_texts": (_tool_texts, TOOLS_SQL),
    "model_answers": (
        _model_answers,
        f"WITH {model.AGENTS_SQL} SELECT agent_id, 'ask ' || lower(name) AS prompt, CASE WHEN name NOT LIKE '%7' THEN upper('ask ' || name) END AS answer FROM agents",
    ),
    "prepared_agents": (
        _prepared,
        f"""{N} SELECT id, regexp_replace(replace(lower(name), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') || '_' || (100 + CAST(('0x' || substr(md5(name), 1, 8)) AS BIGINT) % 900) AS user_name,
        coalesce(nullif(left(summary, 150), ''), 'Nation: ' || name) AS bio, CASE WHEN id LIKE 'N%' THEN 'Nation' ELSE 'Supplier' END AS profession, 0.7 AS activity_level, 'neutral' AS stance FROM nodes WHERE list_contains(labels, 'Nation') OR list_contains(labels, 'Supplier')""",
    ),
    "interview_plan": (
        _interview_plan,
        f"""WITH {model.INTERVIEWS_SQL}, {model.AGENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY platform, agent_id ORDER BY conv_id DESC, turn DESC) AS i FROM interviews), g AS (SELECT agent_id FROM agents ORDER BY agent_id LIMIT 5)
        SELECT g.agent_id, md5(coalesce(max(r.response) FILTER (WHERE platform = 'reddit'), max(r.response) FILTER (WHERE platform = 'twitter'), '(no answer)')) AS answer FROM g LEFT JOIN r ON r.agent_id = g.agent_id AND r.i = 1 GROUP BY g.agent_id""",
    ),
    "profile_snapshot": (
        _snapshot,
        "SELECT r_regionkey AS simulation_id, CASE WHEN r_regionkey = 1 THEN 0 ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS n_profiles, 9 AS expected, r_regionkey % 2 = 0 AS generating FROM region",
    ),
    "topic_total": (
        lambda s, d: reports.topic_total(tools.profile_rules(graph.typed_entities(model.nodes(s, d)))),
        f"{N} SELECT CAST(2 * count(*) AS BIGINT) AS topics FROM nodes WHERE len(list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))) > 0",
    ),
    "memory_update_stats": (
        _memory_stats,
        f"{A} SELECT platform, count(*) AS activities, CAST(ceil(count(*) / 5.0) AS BIGINT) AS batches, CAST(count(*) // 5 AS BIGINT) AS full_batches, CAST(count(*) % 5 AS BIGINT) AS waiting FROM actions GROUP BY platform",
    ),
    "prepared_check": (
        lambda s, d: _prepared_check(s, d),
        """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'twitter_profiles.csv' ELSE 'state.json,simulation_config.json,reddit_profiles.json,twitter_profiles.csv' END AS missing,
        n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 AS prepared FROM nation""",
    ),
    "new_and_unused": (
        lambda s, d: model.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("used"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("known"))
        .select("l_suppkey", F.array_join(F.array_sort(reports.new_facts(F.col("used"), F.col("known"))), ",").alias("new"), F.array_join(F.array_sort(reports.unused_tools(F.col("used"), ("A", "N", "X"))), ",").alias("unused")),
        """WITH m AS (SELECT l_suppkey, l_returnflag, bool_or(l_quantity > 25) AS known FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE NOT known), '') AS new,
        CASE WHEN bool_or(l_returnflag = 'A') THEN '' ELSE 'A,' END || CASE WHEN bool_or(l_returnflag = 'N') THEN '' ELSE 'N,' END || 'X' AS unused FROM m GROUP BY 1""",
    ),
    "hybrid_union": (
        lambda s, d: retrieval.insight_hits(model.edges(s, d), "part of region").groupBy("q").agg(F.count("*").alias("n")),
        f"WITH {model.EDGES_SQL}, {_hits('part of region')} SELECT q, count(*) AS n FROM hits GROUP BY q",
    ),
    "client_keys": (
        lambda s, d: model.actions(s, d).select("seq", reports.client_key(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.col("platform"), F.col("agent_id"), F.col("action_type")).alias("key")),
        f"""{A} SELECT seq, strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '-' || platform || '-' || agent_id || '-' || action_type AS key FROM actions""",
    ),
    "trace_arguments": (
        lambda s, d: model.table(s, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(rules.kept_args(F.create_map(F.lit("content"), "event_type", F.lit("junk"), "event_type", F.lit("post_id"), "event_type")))), ",").alias("kept"), rules.standard_action(F.when(F.col("event_id") % 2 == 0, F.lower(_kind())).otherwise(F.col("event_type"))).alias("action")),
        f"SELECT event_id, 'content,post_id' AS kept, CASE WHEN event_id % 2 = 0 THEN {KIND_SQL} ELSE upper(event_type) END AS action FROM events",
    ),
    "type_maps": (
        lambda s, d: actions.histogram_maps(model.actions(s, d), "agent_id").select("agent_id", F.to_json("action_types").alias("types")),
        f"""{A}, h AS (SELECT agent_id, action_type, count(*) AS n FROM actions GROUP BY ALL) SELECT agent_id, '{{' || string_agg('"' || action_type || '":' || n, ',' ORDER BY action_type) || '}}' AS types FROM h GROUP BY agent_id""",
    ),
    "progress_values": (
        lambda s, d: model.table(s, d, "part").select("p_partkey", rules.build_progress("send", F.col("p_size") / 50).alias("send"), rules.build_progress("process", F.col("p_size") / 50).alias("process"), rules.report_progress(F.col("p_size"), F.lit(50)).alias("report"), rules.progress_class(F.col("p_size") - 10, F.lit(30)).alias("class")),
        """SELECT p_partkey, CAST(15 + floor(40 * (p_size / 50.0)) AS BIGINT) AS send, CAST(55 + floor(35 * (p_size / 50.0)) AS BIGINT) AS process, CAST(20 + floor(70 * p_size / 50.0) AS BIGINT) AS report,
        CASE WHEN p_size <= 10 THEN 'not-started' WHEN p_size >= 40 THEN 'completed' ELSE 'in-progress' END AS class FROM part""",
    ),
    "aged_tasks": (
        lambda s, d: reports.aged(_tasks(s, d), F.expr("TIMESTAMP_NTZ'1996-01-01'")).select("task_id", "status"),
        f"SELECT o_orderkey AS task_id, ['completed', 'failed', 'running'][o_orderkey % 3 + 1] AS status FROM orders WHERE o_orderkey % 3 < 2 AND o_orderdate < {NOW} - INTERVAL 24 HOUR",
    ),
    "newest_tasks": (
        lambda s, d: reports.newest_tasks(_tasks(s, d), "f").limit(50).select("task_id", "status"),
        "SELECT o_orderkey AS task_id, ['completed', 'failed', 'running'][o_orderkey % 3 + 1] AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    ),
    "date_forms": (
        lambda s, d: model.actions(s, d).select("seq", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.date_format("timestamp", "HH:mm").alias("clock")),
        f"""{A} SELECT seq, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS iso, strftime("timestamp", '%Y-%m-%d') AS day, strftime("timestamp", '%H:%M') AS clock FROM actions""",
    ),
    "answers_split": (
        lambda s, d: _answers(s, d),
        "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|' || n_regionkey ELSE n_name END AS answers, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE n_name END AS second FROM nation",
    ),
    "section_forms": (
        lambda s, d: _sections(s, d),
        """SELECT n_nationkey, '**Part**' || chr(10) || chr(10) || n_name AS section, '# ' || n_name || chr(10) || chr(10) || chr(10) || 'text' AS report FROM nation""",
    ),
}


def _prepared_check(s, d) -> DataFrame:
    files = F.array(*map(F.lit, reports.PREPARED_FILES))
    present = F.when(F.col("n_nationkey") % 3 == 0, files).when(F.col("n_nationkey") % 3 == 1, F.slice(files, 1, 3)).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("n_nationkey") % 2 == 0, "ready").otherwise("created")
    return model.table(s, d, "nation").select("n_nationkey", F.array_join(reports.missing_files(present), ",").alias("missing"), reports.is_prepared(present, status, F.col("n_nationkey") % 5 != 0).alias("prepared"))


def _answers(s, d) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Question 1: "), "n_name", F.lit("\nQuestion 2: "), "n_regionkey")).otherwise(F.col("n_name"))
    parts = render.answers_of(raw)
    return model.table(s, d, "nation").select("n_nationkey", F.array_join(parts, "|").alias("answers"), render.answer_at(parts, 1).alias("second"))


def _sections(s, d) -> DataFrame:
    section = F.concat(F.lit("# T\n\n---\n## Part\n"), "n_name", F.lit("\n---\n\n"))
    report = F.concat(F.lit("# "), "n_name", F.lit("\n---\n\n\n\n# "), "n_name", F.lit("\n\n\n\ntext\n"))
    return model.table(s, d, "nation").select("n_nationkey", repair.cleaned_section(section, F.lit("T")).alias("section"), repair.processed_report(report).alias("report"))
