"""Retrieval over a graph: keyword search, panorama, insight, entity views and vectors.

Every list is ranked by score, then id, so equal scores have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions import text
from swarmlens.operators import graph


def search_edges(edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Top edges by the scores of fact and name; those without a hit are left out."""
    q = query
    scored = edges.withColumn("score", text.match_score(F.col("fact"), q) + text.match_score(F.col("name"), q))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def search_nodes(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Top nodes by the scores of name and summary, with ``[name]: summary`` as fact."""
    q = query
    scored = nodes.withColumn("score", text.match_score(F.col("name"), q) + text.match_score(F.col("summary"), q))
    fact = F.when(F.col("summary") != "", F.concat(F.lit("["), "name", F.lit("]: "), "summary"))
    return scored.where("score > 0").withColumn("fact", fact).orderBy(F.desc("score"), "id").limit(limit)


def panorama(edges: DataFrame, query: str, limit: int = 50, historical: bool = False) -> DataFrame:
    """Ranked active - or historical - facts; those that score 0 stay, last.

    A historical fact begins with the span it held.
    """
    rows = graph.historical(edges) if historical else graph.active(edges)
    rows = rows.where("fact <> ''")
    if historical:
        until = F.coalesce("invalid_at", "expired_at")
        day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("unknown"))
        rows = rows.withColumn("fact", F.concat(F.lit("["), day("valid_at"), F.lit(" - "), day(until), F.lit("] "), "fact"))
    rows = rows.withColumn("score", text.relevance(F.col("fact"), query))
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def fact_counts(edges: DataFrame) -> DataFrame:
    """One row: active and historical facts before any cut."""
    old = graph.is_expired() | graph.is_invalid()
    return edges.agg(F.count_if(~old).alias("active"), F.count_if(old).alias("historical"))


def sub_queries(query: str, n: int = 4) -> list[str]:
    """Variants of a query to search besides it."""
    return [query, f"who takes part in {query}", f"causes and effects of {query}", f"how {query} developed"][:n]


def insight_hits(edges: DataFrame, query: str, per_query: int = 15, main: int = 20) -> DataFrame:
    """(q, place, id, fact, source, target) of the sub-queries' and the main query's top edges.

    All queries are scored in one projection over the edges, and only hits go
    on; the top of each comes from a window by query that drops rows below the
    cut before they are sorted (rank limit).
    """
    variants = [*sub_queries(query), query]
    score = lambda v: text.match_score(F.col("fact"), v) + text.match_score(F.col("name"), v)
    asked = F.array(*(F.struct(F.lit(k).alias("q"), score(v).alias("score"), F.lit(main if k == len(variants) - 1 else per_query).alias("most")) for k, v in enumerate(variants)))
    hits = F.filter(asked, lambda a: a["score"] > 0)
    scored = edges.select("id", "name", "fact", "source", "target", F.inline(hits))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(f"place <= {max(main, per_query)}").where("place <= most").select("q", "place", "id", "name", "fact", "source", "target")


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``, the first in ``order``."""
    return rows.groupBy(key).agg(F.min(F.struct(*order)).alias("o")).select(key, "o.*")


def insight_facts(edges: DataFrame, query: str) -> DataFrame:
    return first_seen(insight_hits(edges, query).where("fact <> ''"), "fact", "q", "place")


def insight_entities(edges: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """(id, name, n_facts): ends of the hits that are known nodes, and how many hit facts hold their name."""
    hits = insight_hits(edges, query)
    ends = graph.endpoint_ids(hits)
    known = nodes.select("id", F.lower("name").alias("low"), "name").join(ends, "id", "left_semi")
    facts = hits.select(F.lower("fact").alias("fact")).distinct()
    # both sides are bounded by the queries' cuts (95 hits, 190 ends)
    held = known.join(F.broadcast(facts), F.contains("fact", "low"), "left")
    return held.groupBy("id", "name").agg(F.count("fact").alias("n_facts"))


def relation_chains(edges: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """(chain, q, place): rendered relations of the hits, each once."""
    named = graph.with_short_names(insight_hits(edges, query), nodes)
    rows = named.withColumn("chain", text.fact_chain(F.col("source_name"), F.col("name"), F.col("target_name")))
    return first_seen(rows, "chain", "q", "place")


def entity_view(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, edge, fact) of the first node of that name, case aside, with all its edges."""
    node = nodes.where(F.lower("name") == name.lower()).select("id").orderBy("id").limit(1)
    return graph.incident(edges).join(F.broadcast(node.withColumnRenamed("id", "node")), "node").select(F.col("node").alias("id"), "edge", "fact")


def simulation_context(nodes: DataFrame, n: int = 30) -> DataFrame:
    """The first typed entities by id, with their type."""
    return graph.typed_entities(nodes).orderBy("id").limit(n).select("id", "name", "entity_type")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic_top(vectors: DataFrame, query_id: int, k: int = 10) -> DataFrame:
    """(vec_id, similarity) of the vectors nearest to one of them."""
    query = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    near = vectors.crossJoin(F.broadcast(query)).where(F.col("vec_id") != query_id)  # one row
    return near.select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)
