"""Merkle manifest of a dataset (12) by Pregel-style supersteps over RDDs.

Every row is a leaf.  The leaves of a source, by doc_id, and the subroots of
all sources, by source, are hashed up in runs of three until one is left.

1.  Leaves are hashed by Spark expressions and sorted over range partitions.
    A summary of fixed size from each partition - which source it begins and
    ends with, and how many rows of these it has - goes to the driver and
    gives every partition where its sources go on: no task sees a whole source.
2.  A vertex of the lowest superstep is a block of 3**6 neighbouring leaves,
    a whole subtree.  It hashes its subtree by itself.
3.  Up: in every superstep the nodes of a level message their parents; a
    parent that has its children complete hashes them and goes on.  A node
    knows whether it is the last of its level, so that a parent can tell.
    Sources that are down to one node leave the supersteps with their subroot.
4.  Subroots are the leaves of one more tree, by the same steps.
5.  Down: every node that knows its path to the root sends each child that
    path with the child's siblings in front.  Blocks give the paths to leaves.
6.  A proof is text: levels parted by ``/``, the digests of a run by ``,``, the
    place of the node itself ``*``.  Folding puts the digest there, level by
    level, with Spark expressions.

A level has a third of the nodes of the one below, which bounds the number of
tasks of its superstep.  Lost partitions are made again from the shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.merkle_steps import DEPTH, NODES_A_TASK, RUN, Forest, blocks_of, chunks, scan, summary
from swarmlens.llm.scratch import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: dict[str, Column]) -> Column:
    """Digest of a row: of every field ``-`` if null, else its number of bytes, ``:`` and its value."""
    texts = [values[name].cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    steps = F.when(proof == "", F.array().cast("array<string>")).otherwise(F.split(proof, "/"))
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.replace(F.replace(step, F.lit("*"), digest), F.lit(","), F.lit("")), 256))


def manifest(docs: DataFrame, now: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, leaf_now) per row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``now`` is the text of a row as it is found at verification; ``leaf_now``
    is the digest with it.  ``folded(leaf_now, proof)`` equals root if it has
    not changed.  Blocks have 3**depth leaves.  A null of any column is a value of its own; null sources and
    doc_ids come first; rows that repeat a doc_id within a source stand by
    their digests, equal rows side by side in any order; an empty table gives
    no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch, block = Scratch(spark, "merkle"), RUN**depth
    values = {name: F.col(name).cast("long" if name in ("doc_id", "n_chars") else "string") for name in FIELDS}
    leaf = leaf_digest(values)
    later = leaf if now is None else leaf_digest(values | {"text": now})
    leaves = docs.select(values["source"].alias("source"), values["doc_id"].alias("doc_id"), leaf.alias("leaf"), later.alias("later"))
    leaves = leaves.select("source", "leaf", "doc_id", F.when(F.col("later") != F.col("leaf"), F.col("later")).alias("later"))
    leaves = scratch.keep(leaves, "leaves")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "doc_id", "leaf", "later"]
    rows = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).rdd
    summaries = rows.mapPartitionsWithIndex(summary).collect()  # one row of fixed size a partition
    starts, sources, longest = scan(sorted(summaries))
    n = leaves.count()

    blocks = rows.mapPartitionsWithIndex(chunks(starts, block)).groupByKey(tasks).mapValues(blocks_of)
    forest = Forest(blocks, n, longest, depth)
    last = (sources - 1) // block
    subroots = forest.roots.map(lambda x: ((0, x[0] // block), (x[0], x[1])))
    subroots = subroots.groupByKey(min(tasks, 1 + sources // NODES_A_TASK)).map(lambda b: (b[0], ([(digest, rank, step) for rank, (digest, step) in sorted(b[1])], b[0][1] == last)))
    top = Forest(subroots, sources, sources, depth)
    known = top.leaves(top.roots.mapValues(lambda root: (root[1], "", root[0])))
    # a source's path goes on above its subroot
    known = known.map(lambda x: (x[0][1], (x[0][2], x[1], (x[0][0], x[2]))))
    found = forest.leaves(known).map(lambda x: (x[0][1], x[0][0], *x[2], x[1], x[0][2] or x[0][0]))
    return spark.createDataFrame(found, "doc_id long, leaf string, subroot string, root string, proof string, leaf_now string", verifySchema=False)


def verified(docs: DataFrame, now: Column | None = None, **settings) -> DataFrame:
    """One row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``."""
    rows = manifest(docs, now, **settings)
    siblings = F.translate("proof", "/,*", "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("leaf_now"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document (by crc32 of its doc_id; null doc_ids are not among them) is found without its line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    return verified(docs, F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
