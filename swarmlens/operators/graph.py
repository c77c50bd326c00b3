"""Operators over nodes (id, name, labels, summary) and edges (id, name, fact, source, target, *_at).

Node tables are not assumed small: no join here is hinted as a broadcast, and
adaptive execution broadcasts a side only when it measures it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LABELS = ("Entity", "Node")


def custom_labels(labels: str = "labels") -> Column:
    return F.filter(labels, lambda label: ~label.isin(*DEFAULT_LABELS))


def entity_type(labels: str = "labels") -> Column:
    """The first label that isn't a default one, or null."""
    return F.get(custom_labels(labels), F.lit(0))


def typed_entities(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Nodes with a custom label - one of ``types``, if given - and that label as ``entity_type``."""
    own = custom_labels()
    if types is not None:
        own = F.filter(own, lambda label: label.isin(*types))
    return nodes.withColumn("entity_type", F.get(own, F.lit(0))).where("entity_type is not null")


def labelled(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes with the label, default ones included."""
    return nodes.where(F.array_contains("labels", label))


def edges_of(edges: DataFrame, node: str) -> DataFrame:
    """Edges at a node; a loop is there once."""
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def is_expired() -> Column:
    return F.col("expired_at").isNotNull()


def is_invalid() -> Column:
    return F.col("invalid_at").isNotNull()


def active(edges: DataFrame) -> DataFrame:
    return edges.where(~(is_expired() | is_invalid()))


def historical(edges: DataFrame) -> DataFrame:
    return edges.where(is_expired() | is_invalid())


def renderable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are known nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def with_names(edges: DataFrame, nodes: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Edges with source_name and target_name; a missing name is empty or, with ``short``, eight characters of the id."""
    names = nodes.select("id", "name")
    out = edges
    for side in ("source", "target"):
        out = out.join(names.toDF(side, f"{side}_name"), side, "left")
    return out.withColumns({f"{s}_name": F.coalesce(f"{s}_name", F.lit("")) for s in ("source", "target")})


def with_short_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    named = with_names(edges, nodes)
    return named.withColumns({f"{s}_name": F.coalesce(F.nullif(f"{s}_name", F.lit("")), F.left(F.col(s), F.lit(8))) for s in ("source", "target")})


def incident(edges: DataFrame) -> DataFrame:
    """(node, direction, other, edge, name, fact): each edge at both ends, a loop once as outgoing."""
    rest = [F.col("id").alias("edge"), "name", "fact"]
    outgoing = edges.select(F.col("source").alias("node"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"), *rest)
    incoming = edges.where("source <> target").select(F.col("target").alias("node"), F.lit("incoming").alias("direction"), F.col("source").alias("other"), *rest)
    return outgoing.unionByName(incoming)


def entity_edges(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The incident edges of ``entities``."""
    return incident(edges).join(entities.select(F.col("id").alias("node")), "node", "left_semi")


def neighbours(entities: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, other_name): different known neighbours of each entity."""
    pairs = entity_edges(entities, edges).select("node", "other").distinct()
    return pairs.join(nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").select("node", "other", "other_name")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(F.array_distinct(custom_labels())).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("name").agg(F.count("*").alias("n"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and different custom labels."""
    left = nodes.agg(F.count("*").alias("n_nodes"), F.size(F.array_distinct(F.flatten(F.collect_set(custom_labels())))).alias("n_labels"))
    return left.crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def legend(nodes: DataFrame) -> DataFrame:
    """(type, n, colour): first label but Entity, else Entity; ten colours by the first id of a type."""
    kind = F.coalesce(F.get(F.filter("labels", lambda x: x != "Entity"), F.lit(0)), F.lit("Entity"))
    counts = nodes.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counts.select("type", "n", ((F.row_number().over(Window.orderBy("first")) - 1) % 10).alias("colour"))  # a row per type


def edge_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, n) of node pairs without direction; loops are not pairs."""
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("n"))


def pair_places(edges: DataFrame) -> DataFrame:
    """Each edge's place in its pair by id, the pair's size and the curve it is drawn with."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    rows = edges.where("source <> target").withColumns({"place": F.row_number().over(pair.orderBy("id")) - 1, "of": F.count("*").over(pair)})
    curve = F.when(F.col("of") == 1, 0.0).otherwise((F.col("place") / (F.col("of") - 1) - 0.5) * F.least(F.lit(1.2), 0.6 + 0.15 * F.col("of")))
    return rows.select("id", "place", "of", F.when(F.col("source") > F.col("target"), -curve).otherwise(curve).alias("curve"))


def self_loops(edges: DataFrame) -> DataFrame:
    """(node, n, names): one row for all loops of a node."""
    return edges.where("source = target").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def examples(entities: DataFrame, n: int = 3) -> DataFrame:
    """(entity_type, n, examples): how many entities a type has, and its first names by id."""
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy("id"))
    top = entities.withColumn("place", place).where(F.col("place") <= n).groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("t"))
    total = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    return total.join(top, "entity_type").select("entity_type", "n", F.array_join(F.col("t.name"), ",").alias("examples"))


def summaries(entities: DataFrame, per_type: int = 20, length: int = 300) -> DataFrame:
    """(entity_type, text): up to ``per_type`` lines of a type and one for how many more there are."""
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy("id"))
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.when(F.length("summary") > length, F.concat(F.left("summary", F.lit(length)), F.lit("..."))).otherwise(F.col("summary")))
    top = entities.withColumns({"place": place, "line": line}).where(F.col("place") <= per_type)
    top = top.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("t"))
    total = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > per_type, F.concat(F.lit("\n... and "), (F.col("n") - per_type).cast("string"), F.lit(" more"))).otherwise("")
    return total.join(top, "entity_type").select("entity_type", F.concat(F.array_join(F.col("t.line"), "\n"), more).alias("text"))


def endpoint_ids(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ids.where("id is not null and id <> ''").distinct()
