"""The data model over the driver's tables: actions, nodes, edges, posts, interviews, agents.

Every adapter only selects and renames, so filters and column pruning reach
the Parquet scans.  ``*_SQL`` are the same relations as common table
expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, platform, agent_id, agent_name, action_type, timestamp, round, k, value) from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "twitter").otherwise("reddit").alias("platform"),
        F.col("user_id").alias("agent_id"),
        F.concat(F.lit("Agent_"), F.col("user_id")).alias("agent_name"),
        F.col("event_type").alias("action_type"),
        F.col("ts").alias("timestamp"),
        F.expr(f"timestampdiff(HOUR, {EPOCH}, ts)").alias("round"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
    )


ACTIONS_SQL = """actions AS (
  SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'twitter' ELSE 'reddit' END AS platform,
    user_id AS agent_id, 'Agent_' || user_id AS agent_name, event_type AS action_type, ts AS "timestamp",
    CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS round,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, labels, summary) of customers, suppliers, nations and regions; every tenth customer has default labels only."""
    customer = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit("Entity"), F.lit("Node"))).otherwise(F.array(F.lit("Entity"), F.initcap("c_mktsegment"), F.lit("Customer"))).alias("labels"),
        F.concat(F.lit("customer in segment "), F.lower("c_mktsegment")).alias("summary"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.array(F.lit("Node"), F.lit("Supplier")).alias("labels"),
        F.concat(F.lit("supplier of nation "), "s_nationkey").alias("summary"),
    )
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.lit("Entity"), F.lit("Nation")).alias("labels"), F.lit("").alias("summary"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array(F.lit("Region")).alias("labels"), F.lit("").alias("summary"))
    return customer.unionByName(supplier).unionByName(nation).unionByName(region)


NODES_SQL = """nodes AS (
  SELECT 'C' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN ['Entity', 'Node']
    ELSE ['Entity', upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), 'Customer'] END AS labels,
    'customer in segment ' || lower(c_mktsegment) AS summary FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, ['Node', 'Supplier'], 'supplier of nation ' || s_nationkey FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, n_name, ['Entity', 'Nation'], '' FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name, ['Region'], '' FROM region)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, fact, source, target, valid_at, invalid_at, expired_at): places, and an order's first supplier."""
    none = F.lit(None).cast("timestamp_ntz")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")

    def place(df, prefix, key, name, other):
        where = df.join(F.broadcast(nation.select(F.col("n_nationkey").alias(other), "n_name")), other, "left")  # 25 nations
        return where.select(
            F.concat(F.lit(f"L{prefix}"), key).alias("id"),
            F.lit("LOCATED_IN").alias("name"),
            F.concat(name, F.lit(" is located in "), F.coalesce("n_name", F.lit("nowhere"))).alias("fact"),
            F.concat(F.lit(prefix), key).alias("source"),
            F.concat(F.lit("N"), other).alias("target"),
            none.alias("valid_at"),
            none.alias("invalid_at"),
            none.alias("expired_at"),
        )

    part_of = nation.select(
        F.concat(F.lit("P"), "n_nationkey").alias("id"), F.lit("PART_OF").alias("name"), F.concat("n_name", F.lit(" is part of region "), "n_regionkey").alias("fact"),
        F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target"), none.alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"),
    )
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s"))
    done = F.col("o_orderstatus") == "F"
    placed = table(spark, sf_dir, "orders").join(first, "o_orderkey").select(
        F.concat(F.lit("O"), "o_orderkey").alias("id"), F.lit("PLACED").alias("name"),
        F.concat(F.lit("customer "), "o_custkey", F.lit(" placed order "), "o_orderkey", F.lit(" with supplier "), "s", F.lit(", priority "), F.lower("o_orderpriority")).alias("fact"),
        F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("S"), "s").alias("target"),
        F.col("o_orderdate").alias("valid_at"), F.when(done & (F.col("o_orderkey") % 2 == 0), F.col("o_orderdate")).alias("invalid_at"), F.when(done, F.col("o_orderdate")).alias("expired_at"),
    )
    return place(customer, "C", "c_custkey", "c_name", "c_nationkey").unionByName(place(supplier, "S", "s_suppkey", "s_name", "s_nationkey")).unionByName(part_of).unionByName(placed)


EDGES_SQL = """edges AS (
  SELECT 'LC' || c_custkey AS id, 'LOCATED_IN' AS name, c_name || ' is located in ' || coalesce(n_name, 'nowhere') AS fact,
    'C' || c_custkey AS source, 'N' || c_nationkey AS target, CAST(NULL AS TIMESTAMP) AS valid_at, CAST(NULL AS TIMESTAMP) AS invalid_at, CAST(NULL AS TIMESTAMP) AS expired_at
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'LS' || s_suppkey, 'LOCATED_IN', s_name || ' is located in ' || coalesce(n_name, 'nowhere'), 'S' || s_suppkey, 'N' || s_nationkey, NULL, NULL, NULL
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'P' || n_nationkey, 'PART_OF', n_name || ' is part of region ' || n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'O' || o_orderkey, 'PLACED', 'customer ' || o_custkey || ' placed order ' || o_orderkey || ' with supplier ' || s || ', priority ' || lower(o_orderpriority),
    'C' || o_custkey, 'S' || s, o_orderdate, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_orderdate END, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END
    FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent_id, name, entity_type, segment, balance) of customers; the type follows the segment."""
    kinds = {"AUTOMOBILE": "Company", "BUILDING": "University", "FURNITURE": "MediaOutlet", "HOUSEHOLD": "Student", "MACHINERY": "Professor"}
    mapped = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("agent_id"),
        F.col("c_name").alias("name"),
        F.coalesce(F.try_element_at(mapped, F.col("c_mktsegment")), F.lit("Person")).alias("entity_type"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


AGENTS_SQL = """agents AS (
  SELECT c_custkey AS agent_id, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Company' WHEN 'BUILDING' THEN 'University'
    WHEN 'FURNITURE' THEN 'MediaOutlet' WHEN 'HOUSEHOLD' THEN 'Student' WHEN 'MACHINERY' THEN 'Professor' ELSE 'Person' END AS entity_type,
    c_mktsegment AS segment, c_acctbal AS balance FROM customer)"""


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, agent_id, platform, turn, prompt, response): a user turn and the assistant turn right after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(said, ["conv_id", "turn"]).select(
        "conv_id", (F.col("conv_id") % 50).alias("agent_id"), F.when(F.col("conv_id") % 2 == 0, "twitter").otherwise("reddit").alias("platform"), "turn", "prompt", "response"
    )


INTERVIEWS_SQL = """interviews AS (
  SELECT a.conv_id, a.conv_id % 50 AS agent_id, CASE WHEN a.conv_id % 2 = 0 THEN 'twitter' ELSE 'reddit' END AS platform, a.turn, a.text AS prompt, b.text AS response
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')"""
