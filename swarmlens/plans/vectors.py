"""Nearest vectors by an inverted file: trained centroids, residual codes, probes and exact re-ranking.

The index is built once:

- ``centroids`` (list, center): k-means over a bounded sample of unit vectors;
- ``codes`` (list, part, vec_id, scale, error, code): every vector with its
  nearest centroid; the residual in 8 bits a dimension, and how far that is
  off.  A part has some thousands of vectors, so no list is one task.

A query looks into the lists of its nearest centroids, scores their codes
with one matrix product a part, and re-ranks a shortlist on the vectors
themselves.  ``exact=True`` looks into all lists and shortlists by the bounds
that the errors give: what could be among the k nearest is never left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 100_000  #: vectors that centroids are trained on, at most in the mean
MOST_LISTS = 4096  #: so that the centroids that every task gets have a bounded size
PART = 4096  #: vectors of a part, and queries of a batch, in the mean
_TABLES = {
    "centroids": "list int, center array<double>",
    "assigned": "list int, vec_id long, scale double, error double, code binary",
    "parts": "list int, parts int",
    "codes": "vec_id long, scale double, error double, code binary, part int, list int",
}


def _rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of lists of one length; zero vectors stay."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}")

    def centers(self) -> np.ndarray:
        """At most MOST_LISTS rows, by list."""
        rows = self.table("centroids").orderBy("list").collect()
        return np.array([r["center"] for r in rows])


def build(vectors: DataFrame, folder: str, lists: int | None = None, seed: int = 7) -> VectorIndex:
    """Index ``vectors`` (vec_id, embedding), all of one dimension; null embeddings are left out.

    ``lists`` is the square root of the number of vectors where it isn't given.
    """
    spark = vectors.sparkSession
    index = VectorIndex(spark, folder)
    vectors = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    lists = max(1, min(MOST_LISTS, n, lists or round(n**0.5)))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sample = vectors.sample(min(1.0, SAMPLE / max(n, 1)), seed).where(size > 0).select(F.transform("embedding", lambda x: x / size).alias("unit"))
    model = KMeans(k=lists, seed=seed, maxIter=15, featuresCol="v").fit(sample.select(array_to_vector("unit").alias("v")))
    centers = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centers, "list int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    matrix = index.centers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _rows(batch.column(1))
            home = (unit @ matrix.T - 0.5 * (matrix * matrix).sum(1)).argmax(1)
            rest = unit - matrix[home]
            scale = np.abs(rest).max(1) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            off = rest - code * scale[:, None]
            error = np.sqrt((off * off).sum(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), batch.column(0), pa.array(scale), pa.array(error), pa.array([c.tobytes() for c in code], pa.binary())], names=["list", "vec_id", "scale", "error", "code"]
            )

    coded = vectors.mapInArrow(run, "list int, vec_id long, scale double, error double, code binary")
    coded.write.mode("overwrite").parquet(f"{folder}/assigned")
    coded = index.table("assigned")
    sizes = coded.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes.write.mode("overwrite").parquet(f"{folder}/parts")
    parted = coded.join(F.broadcast(index.table("parts")), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    parted.repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/codes")
    return index


def nearest_many(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8, shortlist: int = 4, exact: bool = False) -> DataFrame:
    """(q, place, vec_id, similarity): the ``k`` vectors most similar (cosine) to each of ``queries`` (q, embedding), other than q itself.

    ``shortlist * k`` candidates of each query are measured on ``vectors``.
    Ties go by vec_id.
    """
    matrix = index.centers()
    asked = queries.where("embedding is not null").select(F.col("q").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("asked"))
    most = len(matrix) if exact else min(probes, len(matrix))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _rows(batch.column(1))
            far = 0.5 * (matrix * matrix).sum(1) - unit @ matrix.T
            lists = np.argpartition(far, most - 1, 1)[:, :most]
            row = pa.array(np.repeat(np.arange(len(unit)), most))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(lists.reshape(-1), pa.int32())], names=["q", "asked", "list"])

    probed = asked.mapInArrow(routed, "q long, asked array<double>, list int").join(F.broadcast(index.table("parts")), "list")
    probed = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    batches = F.broadcast(probed.groupBy("list").agg(F.ceil(F.countDistinct("q") / PART).cast("int").alias("batches")))  # a row a list
    probed = probed.join(batches, "list").withColumn("batch", F.pmod(F.xxhash64("q"), F.col("batches")).cast("int")).drop("batches")
    codes = index.table("codes").join(batches, "list").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def scored(asking: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or stored.empty:
            return pd.DataFrame({"q": [], "vec_id": [], "score": [], "error": []}).astype({"q": "int64", "vec_id": "int64"})
        unit = np.stack(asking["asked"].to_numpy()).astype(np.float64)
        size = np.sqrt((unit * unit).sum(1, keepdims=True))
        unit /= np.where(size > 0, size, 1)
        code = np.frombuffer(b"".join(stored["code"]), np.int8).reshape(len(stored), -1).astype(np.float64)
        about = unit @ (matrix[int(stored["list"].iloc[0])] + code * stored["scale"].to_numpy()[:, None]).T
        ids, error, q = stored["vec_id"].to_numpy(), stored["error"].to_numpy(), asking["q"].to_numpy()
        about[q[:, None] == ids[None, :]] = -np.inf
        if exact:
            low = about - error
            at = min(k, low.shape[1]) - 1
            least = -np.partition(-low, at, 1)[:, at] if low.shape[1] >= k else np.full(len(q), -np.inf)
            i, j = np.nonzero((about + error >= least[:, None] - 1e-9) & np.isfinite(about))
        else:
            some = min(shortlist * k, about.shape[1])
            j = np.argpartition(-about, some - 1, 1)[:, :some].reshape(-1)
            i = np.repeat(np.arange(len(q)), some)
            real = np.isfinite(about[i, j])
            i, j = i[real], j[real]
        return pd.DataFrame({"q": q[i], "vec_id": ids[j], "score": about[i, j], "error": error[j]})

    keys = ["list", "part", "batch"]
    found = probed.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(scored, "q long, vec_id long, score double, error double")
    window = Window.partitionBy("q")
    if exact:
        ranked = found.withColumn("at", F.row_number().over(window.orderBy(F.desc(F.col("score") - F.col("error")))))
        least = F.min(F.when(F.col("at") <= k, F.col("score") - F.col("error"))).over(window)
        found = ranked.withColumn("least", least).where("score + error >= least - 1e-9")
    else:
        found = found.withColumn("at", F.row_number().over(window.orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= shortlist * k)
    pairs = found.select("q", "vec_id").join(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("own")), "vec_id").join(asked, "q")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    similar = F.coalesce(F.try_divide(dot("own", "asked"), F.sqrt(dot("own", "own") * dot("asked", "asked"))), F.lit(0.0))
    measured = pairs.select("q", "vec_id", F.round(similar, 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "vec_id"))
    return measured.withColumn("place", place).where(F.col("place") <= k).select("q", "place", "vec_id", "similarity")
