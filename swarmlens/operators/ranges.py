"""Ranks over whole tables without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_IN_RANGE = 250_000


def numbered(rows: DataFrame, key: str, *groups: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``place``, their rank by a number ``key`` from 0 within ``groups`` (null is a group).

    Rows are counted by ranges of the key first, each range starts at the sum
    of those before it, and windows sort one range at a time.  The ranges are
    approximate quantiles, so a few outlying keys don't put all rows into one;
    there are more of them the more rows there are.
    """
    if ranges is None:
        ranges = max(16, min(4096, rows.count() // ROWS_IN_RANGE))
    cuts = rows.agg(F.percentile_approx(F.col(key).cast("double"), [k / ranges for k in range(1, ranges)], 20 * ranges).alias("cuts"))
    found = sorted(set((cuts.first()["cuts"] or [])))  # ``ranges`` numbers
    # the range of a row: how many cuts are below its key, by bisection in code
    at = _bisected(F.col(key).cast("double"), found)
    ranged = rows.withColumn("_range", at)
    sizes = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(key)) - 1
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    joined = ranged.withColumn("_in", place).join(starts, same)
    return joined.select(*rows.columns, (F.col("_in") + F.col("_start")).alias("place"))


def _bisected(key, cuts: list[float]):
    """How many of the sorted ``cuts`` are below ``key``; null keys come first."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))
    return F.coalesce(F.size(F.filter(table, lambda c: c < key)), F.lit(0)) if len(cuts) <= 64 else _steps(key, cuts)


def _steps(key, cuts: list[float]):
    """The same in two steps: a coarse table, then the cuts of its part."""
    width = int(len(cuts) ** 0.5) + 1
    coarse, parts = F.array(*map(F.lit, cuts[width - 1 :: width])), [cuts[k : k + width] for k in range(0, len(cuts), width)]
    first = F.size(F.filter(coarse, lambda c: c < key))
    inner = F.size(F.filter(F.get(F.array(*(F.array(*map(F.lit, p)) for p in parts)), first), lambda c: c < key))
    return F.coalesce(first * width + F.coalesce(inner, F.lit(0)), F.lit(0))
