"""Queries over the text and vector indexes, and mentions of entities in facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.operators import mentions
from swarmlens.plans import ranked, vectors
from swarmlens.queries.retrieval import ASK
from swarmlens.sources import model
from swarmlens.sources.folders import work_folder

_BUILT: dict = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, build):
    """An index is built once a session for the tables of a folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _BUILT:
        _BUILT[key] = build(work_folder(spark, f"index-{kind}"))
    return _BUILT[key]


def edge_index(spark: SparkSession, sf_dir: str) -> ranked.Index:
    text = F.concat_ws(" ", "name", "fact")
    return _once(spark, sf_dir, "edges", lambda folder: ranked.build(model.edges(spark, sf_dir).select(F.col("id").alias("doc"), text.alias("text")), folder))


def node_index(spark: SparkSession, sf_dir: str) -> ranked.Index:
    docs = model.nodes(spark, sf_dir).select(F.col("id").alias("doc"), F.concat_ws(" ", "name", "summary").alias("text"))
    # nodes are short and may stand in a file or two, which few tasks would cut into words
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _once(spark, sf_dir, "nodes", lambda folder: ranked.build(docs.repartition(tasks, "doc"), folder))


def _document_index(spark: SparkSession, sf_dir: str) -> ranked.Index:
    return _once(spark, sf_dir, "documents", lambda folder: ranked.build(model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), folder))


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    return _once(spark, sf_dir, "vectors", lambda folder: vectors.build(model.table(spark, sf_dir, "embeddings"), folder))


def _customer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth customer asks for itself in other words."""
    return model.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("q"), F.concat(F.lit("customer "), "c_custkey", F.lit(" order with supplier "), "c_nationkey", F.lit(" in "), "c_mktsegment").alias("text"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")


def _near(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return vectors.nearest_many(vector_index(spark, sf_dir), model.table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), **settings)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their words and by the vector of the same number, fused."""
    words = ranked.search_many(node_index(spark, sf_dir), _customer_queries(spark, sf_dir), 50)
    near = _near(spark, sf_dir, k=50, exact=True).select("q", "place", F.concat(F.lit("C"), "vec_id").alias("doc"))
    return ranked.fused(words, near, k=20).withColumnRenamed("doc", "id")


def _mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold the name of a node, or the second to fourth word of a benchmark item."""
    nodes = model.nodes(spark, sf_dir).select(F.col("id").alias("name_id"), "name")
    phrase = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    items = model.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), "item_id").alias("name_id"), phrase.alias("name"))
    docs = model.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    found = mentions.mentions(nodes.unionByName(items), docs)
    return found.select(F.col("text_id").alias("doc_id"), F.col("name_id").alias("id"))


def bm25(docs: str, queries: str, k: int) -> str:
    """Common table expressions of the ranking ``top`` (q, place, doc, score) over ``docs`` (doc, text) and ``queries`` (q, text)."""
    term = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"
    return rf"""docs AS ({docs}), queries AS ({queries}), words AS (SELECT doc, {term} AS term FROM docs), lengths AS (SELECT doc, count(*) AS length FROM words GROUP BY doc),
    totals AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM docs) AS mean), tf AS (SELECT doc, term, count(*) AS times FROM words GROUP BY doc, term),
    often AS (SELECT term, count(*) AS often FROM tf GROUP BY term), asked AS (SELECT q, term, count(*) AS w FROM (SELECT q, {term} AS term FROM queries) GROUP BY q, term),
    scores AS (SELECT q, doc, round(sum(w * ln(1 + (n - often + 0.5) / (often + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM asked JOIN tf USING (term) JOIN often USING (term) JOIN lengths USING (doc), totals GROUP BY q, doc),
    top AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS place, doc, score FROM scores) WHERE place <= {k})"""


_EDGE_DOCS = "SELECT id AS doc, name || ' ' || fact AS text FROM edges"
_NODE_DOCS = "SELECT id AS doc, name || ' ' || summary AS text FROM nodes"
_CUSTOMERS = "SELECT c_custkey AS q, 'customer ' || c_custkey || ' order with supplier ' || c_nationkey || ' in ' || c_mktsegment AS text FROM customer WHERE c_custkey % 100 = 0"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_SIMILAR = f"{_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')})"


def nearest(k: int) -> str:
    return f"""near AS (SELECT * FROM (SELECT q, vec_id, similarity, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, vec_id) AS place
      FROM (SELECT a.vec_id AS q, b.vec_id, round({_SIMILAR}, 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE place <= {k})"""


QUERIES = {
    "ranked_edges": (
        lambda s, d: ranked.search(edge_index(s, d), ASK, 25).withColumnRenamed("doc", "id"),
        f"WITH {model.EDGES_SQL}, {bm25(_EDGE_DOCS, f'SELECT 0 AS q, {ASK!r} AS text', 25)} SELECT place, doc AS id, score FROM top",
    ),
    "ranked_nodes": (
        lambda s, d: ranked.search(node_index(s, d), "machinery customer, or a supplier of nation 7 or 7", 25).withColumnRenamed("doc", "id"),
        f"WITH {model.NODES_SQL}, {bm25(_NODE_DOCS, 'SELECT 0 AS q, $$machinery customer, or a supplier of nation 7 or 7$$ AS text', 25)} SELECT place, doc AS id, score FROM top",
    ),
    "ranked_many": (
        lambda s, d: ranked.search_many(edge_index(s, d), _customer_queries(s, d), 10).withColumnRenamed("doc", "id"),
        f"WITH {model.EDGES_SQL}, {bm25(_EDGE_DOCS, _CUSTOMERS, 10)} SELECT q, place, doc AS id, score FROM top",
    ),
    "ranked_documents": (
        lambda s, d: ranked.search_many(_document_index(s, d), model.table(s, d, "benchmark").select(F.col("item_id").alias("q"), "text"), 5).withColumn("doc", F.col("doc").cast("long")),
        f"WITH {bm25('SELECT CAST(doc_id AS VARCHAR) AS doc, text FROM documents', 'SELECT item_id AS q, text FROM benchmark', 5)} SELECT q, place, CAST(doc AS BIGINT) AS doc, score FROM top",
    ),
    "vector_topk": (lambda s, d: _near(s, d), None),
    "vector_topk_exact": (
        lambda s, d: _near(s, d, exact=True).withColumn("similarity", F.round("similarity", 6)),
        f"WITH {nearest(10)} SELECT q, place, vec_id, round(similarity, 6) AS similarity FROM near",
    ),
    "hybrid_nodes": (
        _hybrid,
        f"""WITH {model.NODES_SQL}, {bm25(_NODE_DOCS, _CUSTOMERS, 50)}, {nearest(50)},
        shares AS (SELECT q, doc, 1.0::DOUBLE / (60 + place) AS share FROM top UNION ALL SELECT q, 'C' || vec_id, 1.0::DOUBLE / (60 + place) FROM near), summed AS (SELECT q, doc, round(sum(share), 9) AS score FROM shares GROUP BY q, doc)
        SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS place, doc AS id, score FROM summed) WHERE place <= 20""",
    ),
    "entity_mentions": (
        lambda s, d: mentions.mention_counts(model.nodes(s, d).select(F.col("id").alias("name_id"), "name"), model.edges(s, d).select(F.col("id").alias("text_id"), F.col("fact").alias("text"))).withColumnRenamed("name_id", "id").withColumnRenamed("n_texts", "n_facts"),
        f"WITH {model.NODES_SQL}, {model.EDGES_SQL} SELECT n.id, count(e.id) AS n_facts FROM nodes n LEFT JOIN edges e ON contains(lower(e.fact), lower(n.name)) GROUP BY n.id",
    ),
    "mentioned_names": (
        lambda s, d: _mentioned(s, d),
        f"WITH {model.NODES_SQL} SELECT d.doc_id, n.id FROM documents d JOIN (SELECT id, name FROM nodes UNION ALL SELECT 'B' || item_id, array_to_string(string_split(text, ' ')[2:4], ' ') FROM benchmark) n ON n.name <> '' AND contains(lower(d.text), lower(n.name))",
    ),
}
