"""Joins of a caller's documents with an operator's results, whatever other columns the documents have."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.scratch import Scratch
from swarmlens.llm.sketch import among, marked_bits


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and where each name went."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def parted(rows: DataFrame, value: Column, values: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose ``value`` may be in the one column of ``values``, a kept table, and those whose value is not.

    A bit array of bounded size tells them apart, so that a join shuffles the
    first only; where ``values`` are too many for it, all rows may be there.
    """
    marked = marked_bits(values.select(F.xxhash64(values.columns[0]).alias("h")))
    if marked is None:
        return rows, None

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(among(marked, h.to_numpy(np.int64).view(np.uint64)))

    held = may(F.xxhash64(value))
    return rows.where(held), rows.where(~held)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in the one column of ``ids``; a null is like any value."""
    rows, place = numbered(docs)
    own = rows[place["doc_id"]].cast("long")
    gone = Scratch(docs.sparkSession, "without").keep(ids.toDF("gone").select(F.col("gone").cast("long")).distinct(), "gone")
    some, others = parted(rows, own, gone)
    left = some.join(gone, own.eqNullSafe(gone["gone"]), "left_anti")
    return (left if others is None else left.unionByName(others)).toDF(*docs.columns)
