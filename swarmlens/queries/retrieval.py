"""Queries over retrieval plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens.functions import text
from swarmlens.plans import retrieval as ops
from swarmlens.sources import model

N = "WITH " + model.NODES_SQL
E = "WITH " + model.EDGES_SQL
NE = f"WITH {model.NODES_SQL}, {model.EDGES_SQL}"
ASK = "order 7 with urgent, priority"


def _words(query: str) -> list[str]:
    return [w for w in query.lower().replace(",", " ").split() if len(w) > 1]


def _match(column: str, query: str) -> str:
    hits = " + ".join(f"CASE WHEN contains(lower({column}), '{w}') THEN 10 ELSE 0 END" for w in _words(query)) or "0"
    return f"(CASE WHEN coalesce({column}, '') = '' THEN 0 WHEN contains(lower({column}), '{query.lower()}') THEN 100 ELSE {hits} END)"


def _relevance(column: str, query: str) -> str:
    hits = " + ".join(f"CASE WHEN contains(lower({column}), '{w}') THEN 10 ELSE 0 END" for w in _words(query)) or "0"
    return f"(CASE WHEN contains(lower({column}), '{query.lower()}') THEN 100 ELSE 0 END + {hits})"


def _hits(query: str) -> str:
    variants = [*ops.sub_queries(query), query]
    parts = [
        f"SELECT {k} AS q, * FROM (SELECT row_number() OVER (ORDER BY score DESC, id) AS place, * FROM (SELECT id, name, fact, source, target, {_match('fact', v)} + {_match('name', v)} AS score FROM edges) WHERE score > 0) WHERE place <= {20 if k == len(variants) - 1 else 15}"
        for k, v in enumerate(variants)
    ]
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


HISTORICAL = "(expired_at IS NOT NULL OR invalid_at IS NOT NULL)"

QUERIES = {
    "keyword_search": (
        lambda s, d: ops.search_edges(model.edges(s, d), ASK, 25).select("id", "fact", "score"),
        f"{E} SELECT id, fact, score FROM (SELECT id, fact, {_match('fact', ASK)} + {_match('name', ASK)} AS score FROM edges) WHERE score > 0 ORDER BY score DESC, id LIMIT 25",
    ),
    "keyword_search_nodes": (
        lambda s, d: ops.search_nodes(model.nodes(s, d), "machinery customer", 25).select("id", "fact", "score"),
        f"{N} SELECT id, CASE WHEN summary <> '' THEN '[' || name || ']: ' || summary END AS fact, score FROM (SELECT *, {_match('name', 'machinery customer')} + {_match('summary', 'machinery customer')} AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, id LIMIT 25",
    ),
    "panorama": (
        lambda s, d: ops.panorama(model.edges(s, d), ASK).select("id", "fact", "score"),
        f"{E} SELECT id, fact, {_relevance('fact', ASK)} AS score FROM edges WHERE NOT {HISTORICAL} AND fact <> '' ORDER BY score DESC, id LIMIT 50",
    ),
    "panorama_historical": (
        lambda s, d: ops.panorama(model.edges(s, d), ASK, historical=True).select("id", "fact", "score"),
        f"""{E}, old AS (SELECT id, '[' || coalesce(strftime(valid_at, '%Y-%m-%d'), 'unknown') || ' - ' || coalesce(strftime(coalesce(invalid_at, expired_at), '%Y-%m-%d'), 'unknown') || '] ' || fact AS fact FROM edges WHERE {HISTORICAL})
        SELECT id, fact, {_relevance('fact', ASK)} AS score FROM old ORDER BY score DESC, id LIMIT 50""",
    ),
    "panorama_counts": (
        lambda s, d: ops.fact_counts(model.edges(s, d)),
        f"{E} SELECT count(*) FILTER (WHERE NOT {HISTORICAL}) AS active, count(*) FILTER (WHERE {HISTORICAL}) AS historical FROM edges",
    ),
    "insight_facts": (
        lambda s, d: ops.insight_facts(model.edges(s, d), "supplier 3"),
        f"{E}, {_hits('supplier 3')} SELECT fact, CAST(split_part(m, ':', 1) AS INTEGER) AS q, CAST(split_part(m, ':', 2) AS INTEGER) AS place FROM (SELECT fact, min(q || ':' || lpad(CAST(place AS VARCHAR), 3, '0')) AS m FROM hits GROUP BY fact)",
    ),
    "insight_entities": (
        lambda s, d: ops.insight_entities(model.edges(s, d), model.nodes(s, d), "supplier 3"),
        f"""{NE}, {_hits('supplier 3')}, ends AS (SELECT source AS id FROM hits UNION SELECT target FROM hits), facts AS (SELECT DISTINCT lower(fact) AS fact FROM hits)
        SELECT n.id, n.name, count(f.fact) AS n_facts FROM nodes n JOIN ends USING (id) LEFT JOIN facts f ON contains(f.fact, lower(n.name)) GROUP BY n.id, n.name""",
    ),
    "relation_chains": (
        lambda s, d: ops.relation_chains(model.edges(s, d), model.nodes(s, d), "supplier 3").select("chain"),
        f"""{NE}, {_hits('supplier 3')} SELECT DISTINCT coalesce(nullif(a.name, ''), left(source, 8)) || ' --[' || h.name || ']--> ' || coalesce(nullif(b.name, ''), left(target, 8)) AS chain
        FROM hits h LEFT JOIN nodes a ON a.id = source LEFT JOIN nodes b ON b.id = target""",
    ),
    "entity_summary": (
        lambda s, d: ops.entity_view(model.nodes(s, d), model.edges(s, d), "CUSTOMER#000000007"),
        f"{NE}, one AS (SELECT min(id) AS id FROM nodes WHERE lower(name) = 'customer#000000007') SELECT one.id, e.id AS edge, fact FROM one, edges e WHERE source = one.id OR target = one.id",
    ),
    "simulation_context": (
        lambda s, d: ops.simulation_context(model.nodes(s, d)),
        f"{N} SELECT id, name, list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))[1] AS entity_type FROM nodes WHERE len(list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))) > 0 ORDER BY id LIMIT 30",
    ),
    "semantic_topk": (
        lambda s, d: ops.semantic_top(model.table(s, d, "embeddings"), 3).select("vec_id", F.round("similarity", 6).alias("similarity")),
        """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
          / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS similarity
        FROM embeddings, q WHERE vec_id <> 3 ORDER BY similarity DESC, vec_id LIMIT 10""",
    ),
    "query_keywords": (
        lambda s, d: model.table(s, d, "part").select("p_partkey", F.array_join(text.keywords(F.concat_ws(",", "p_name", "p_type")), " ").alias("words")),
        "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(translate(lower(p_name || ',' || p_type), ',，', '  '), '\\s+'), lambda w: length(w) > 1), ' ') AS words FROM part",
    ),
    "part_name_scores": (
        lambda s, d: model.table(s, d, "part").where(text.match_score(F.col("p_name"), F.lit("red widget")) > 0).select("p_partkey", text.match_score(F.col("p_name"), F.lit("red widget")).alias("score")),
        f"SELECT p_partkey, {_match('p_name', 'red widget')} AS score FROM part WHERE {_match('p_name', 'red widget')} > 0",
    ),
}
