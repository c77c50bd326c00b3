"""Queries over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens.operators import graph as ops
from swarmlens.sources import model

N = "WITH " + model.NODES_SQL
E = "WITH " + model.EDGES_SQL
NE = f"WITH {model.NODES_SQL}, {model.EDGES_SQL}"
OWN = "list_filter(labels, lambda x: x NOT IN ('Entity', 'Node'))"
INCIDENT = """incident AS (SELECT source AS node, 'outgoing' AS direction, target AS other, id AS edge, name, fact FROM edges
  UNION ALL SELECT target, 'incoming', source, id, name, fact FROM edges WHERE source <> target)"""
HISTORICAL = "(expired_at IS NOT NULL OR invalid_at IS NOT NULL)"

QUERIES = {
    "typed_entities": (
        lambda s, d: ops.typed_entities(model.nodes(s, d)).select("id", "name", "entity_type"),
        f"{N} SELECT id, name, {OWN}[1] AS entity_type FROM nodes WHERE len({OWN}) > 0",
    ),
    "typed_entities_listed": (
        lambda s, d: ops.typed_entities(model.nodes(s, d), ["Customer", "Nation"]).select("id", "entity_type"),
        f"{N} SELECT id, list_filter({OWN}, lambda x: x IN ('Customer', 'Nation'))[1] AS entity_type FROM nodes WHERE len(list_filter({OWN}, lambda x: x IN ('Customer', 'Nation'))) > 0",
    ),
    "entities_by_type": (
        lambda s, d: ops.labelled(model.nodes(s, d), "Node").select("id", "name"),
        f"{N} SELECT id, name FROM nodes WHERE list_contains(labels, 'Node')",
    ),
    "node_detail": (
        lambda s, d: model.nodes(s, d).where("id = 'C7'").select("id", "name", "summary"),
        f"{N} SELECT id, name, summary FROM nodes WHERE id = 'C7'",
    ),
    "node_edges": (
        lambda s, d: ops.edges_of(model.edges(s, d), "C7").select("id", "name", "fact"),
        f"{E} SELECT id, name, fact FROM edges WHERE source = 'C7' OR target = 'C7'",
    ),
    "graph_data": (
        lambda s, d: ops.with_names(model.edges(s, d), model.nodes(s, d)).select("id", "name", "source_name", "target_name"),
        f"{NE} SELECT e.id, e.name, coalesce(a.name, '') AS source_name, coalesce(b.name, '') AS target_name FROM edges e LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target",
    ),
    "edge_short_names": (
        lambda s, d: ops.with_short_names(model.edges(s, d), model.nodes(s, d).where("id not like 'S%'")).select("id", "source_name", "target_name"),
        f"{NE} SELECT e.id, coalesce(nullif(a.name, ''), left(e.source, 8)) AS source_name, coalesce(nullif(b.name, ''), left(e.target, 8)) AS target_name FROM edges e LEFT JOIN nodes a ON a.id = e.source AND a.id NOT LIKE 'S%' LEFT JOIN nodes b ON b.id = e.target AND b.id NOT LIKE 'S%'",
    ),
    "entity_context": (
        lambda s, d: ops.entity_edges(ops.typed_entities(model.nodes(s, d), ["Customer"]), model.edges(s, d)).select("node", "direction", "other", "edge"),
        f"{NE}, {INCIDENT} SELECT node, direction, other, edge FROM incident WHERE node IN (SELECT id FROM nodes WHERE list_contains(labels, 'Customer'))",
    ),
    "entity_neighbours": (
        lambda s, d: ops.neighbours(ops.typed_entities(model.nodes(s, d), ["Supplier"]), model.edges(s, d), model.nodes(s, d)),
        f"{NE}, {INCIDENT} SELECT DISTINCT node, other, n.name AS other_name FROM incident JOIN nodes n ON n.id = other WHERE node IN (SELECT id FROM nodes WHERE list_contains(labels, 'Supplier'))",
    ),
    "graph_stats": (
        lambda s, d: ops.sizes(model.nodes(s, d), model.edges(s, d)),
        f"{NE} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT CAST(count(DISTINCT x) AS INTEGER) FROM (SELECT unnest({OWN}) AS x FROM nodes)) AS n_labels, (SELECT count(*) FROM edges) AS n_edges",
    ),
    "label_counts": (
        lambda s, d: ops.label_counts(model.nodes(s, d)),
        f"{N} SELECT label, count(*) AS n FROM (SELECT id, unnest(list_distinct({OWN})) AS label FROM nodes) GROUP BY label",
    ),
    "relation_types": (
        lambda s, d: ops.relation_counts(model.edges(s, d)),
        f"{E} SELECT name, count(*) AS n FROM edges GROUP BY name",
    ),
    "legend_types": (
        lambda s, d: ops.legend(model.nodes(s, d)),
        f"""{N}, t AS (SELECT coalesce(list_filter(labels, lambda x: x <> 'Entity')[1], 'Entity') AS type, count(*) AS n, min(id) AS first FROM nodes GROUP BY 1)
        SELECT type, n, CAST((row_number() OVER (ORDER BY first) - 1) % 10 AS INTEGER) AS colour FROM t""",
    ),
    "edge_pairs": (
        lambda s, d: ops.edge_pairs(model.edges(s, d)),
        f"{E} SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM edges WHERE source <> target GROUP BY ALL",
    ),
    "edge_pair_places": (
        lambda s, d: ops.pair_places(model.edges(s, d)).withColumn("curve", F.round("curve", 6) + F.lit(0.0)),
        f"""{E}, p AS (SELECT id, source, target, CAST(row_number() OVER w - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS "of"
          FROM edges WHERE source <> target WINDOW w AS (PARTITION BY least(source, target), greatest(source, target) ORDER BY id))
        SELECT id, place, "of", round(CASE WHEN source > target THEN -1 ELSE 1 END * CASE WHEN "of" = 1 THEN 0.0 ELSE (place / ("of" - 1) - 0.5) * least(1.2, 0.6 + 0.15 * "of") END, 6) + 0.0 AS curve FROM p""",
    ),
    "self_loops": (
        lambda s, d: ops.self_loops(model.edges(s, d).withColumn("target", F.when(F.substring("id", -1, 1) == "3", F.col("source")).otherwise(F.col("target")))),
        f"{E} SELECT source AS node, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM edges WHERE right(id, 1) = '3' OR source = target GROUP BY source",
    ),
    "active_facts": (
        lambda s, d: ops.active(model.edges(s, d)).select("id", "fact"),
        f"{E} SELECT id, fact FROM edges WHERE NOT {HISTORICAL}",
    ),
    "historical_facts": (
        lambda s, d: ops.historical(model.edges(s, d)).select("id", "fact", ops.is_invalid().alias("invalid")),
        f"{E} SELECT id, fact, invalid_at IS NOT NULL AS invalid FROM edges WHERE {HISTORICAL}",
    ),
    "renderable_edges": (
        lambda s, d: ops.renderable(model.edges(s, d), ops.typed_entities(model.nodes(s, d))).select("id"),
        f"{NE}, known AS (SELECT id FROM nodes WHERE len({OWN}) > 0) SELECT id FROM edges WHERE source IN (SELECT id FROM known) AND target IN (SELECT id FROM known)",
    ),
    "type_examples": (
        lambda s, d: ops.examples(ops.typed_entities(model.nodes(s, d))),
        f"""{N}, t AS (SELECT id, name, {OWN}[1] AS entity_type FROM nodes WHERE len({OWN}) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS place FROM t)
        SELECT entity_type, count(*) AS n, string_agg(name, ',' ORDER BY place) FILTER (WHERE place <= 3) AS examples FROM r GROUP BY entity_type""",
    ),
    "entity_summaries": (
        lambda s, d: ops.summaries(ops.typed_entities(model.nodes(s, d))),
        f"""{N}, t AS (SELECT id, name, summary, {OWN}[1] AS entity_type FROM nodes WHERE len({OWN}) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS place FROM t)
        SELECT entity_type, string_agg('- ' || name || ': ' || summary, chr(10) ORDER BY place) FILTER (WHERE place <= 20) ||
          CASE WHEN count(*) > 20 THEN chr(10) || '... and ' || (count(*) - 20) || ' more' ELSE '' END AS text FROM r GROUP BY entity_type""",
    ),
    "endpoint_ids": (
        lambda s, d: ops.endpoint_ids(model.edges(s, d)),
        f"{E} SELECT source AS id FROM edges UNION SELECT target FROM edges",
    ),
}
