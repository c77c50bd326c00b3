"""Connected components by alternating large-star and small-star steps.

The algorithm is that of Kiveris et al., "Connected Components in MapReduce and
Beyond" (2014).  Every step is a min-aggregation (combined before the shuffle,
so a hub of millions of edges is no hot task) and a join that adaptive
execution may split; nothing is collected and every step's result is a table
in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.scratch import Scratch


def _print(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches by the links (i, j), in memory."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def connected(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of ``edges`` the smallest node it reaches.

    Self-loops and repeated edges don't matter; no edges give no rows.
    """
    pairs = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    pairs = scratch.keep(pairs, "edges")
    mark = _print(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = scratch.keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(least.withColumnRenamed("v", "m"), "u").where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least).distinct()
        small = scratch.keep(small, "small-star")
        scratch.drop(large, pairs)
        now = _print(small)
        pairs = small
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
