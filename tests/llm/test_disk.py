"""What joins shuffle and what tables stay on the shared folder."""

import os

import pytest
from helpers import corpus, table
from pyspark.sql import functions as F

from swarmlens.llm import jaccard_join, line_dedup, rows
from swarmlens.llm.scratch import Scratch, shared_root


def test_a_join_leaves_rows_of_other_ids_where_they_are(spark):
    docs = table(spark, [(k, f"text {k}") for k in range(3000)] + [(None, "a"), (None, "b"), (7, "again")])
    gone = Scratch(spark, "test-parted").keep(spark.createDataFrame([(7,), (8,), (None,), (9999,)], "doc_id long"), "gone")
    some, others = rows.parted(docs, F.col("doc_id").cast("long"), gone)
    assert {7, 8, None} <= {r["doc_id"] for r in some.collect()} and some.count() < 100
    assert not {7, 8, None} & {r["doc_id"] for r in others.collect()} and some.count() + others.count() == 3003
    kept = rows.without(docs, gone)
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(3000) if k not in (7, 8)] and kept.columns == docs.columns


def tables(spark):
    root = shared_root(spark).removeprefix("file:").replace("//", "/")
    return {f"{d}/{x}" for d in os.listdir(root) for x in os.listdir(f"{root}/{d}")}


@pytest.mark.parametrize("stage", [line_dedup.without_repeated_lines, jaccard_join.one_of_each])
def test_stages_leave_only_what_their_result_reads(spark, stage):
    docs, before = table(spark, corpus(seed=9, n=20)), tables(spark)
    left = stage(docs)
    assert len(tables(spark) - before) == 1
    assert left.count() > 0


def test_a_join_of_sets_drops_its_regions(spark):
    before = tables(spark)
    jaccard_join.jaccard_links(table(spark, corpus(seed=9, n=20)), Scratch(spark, "test-links"))
    left = {x.split("/")[1][4:] for x in tables(spark) - before}
    assert "ids" in left and not left & {"entries", "regions", "screened-pairs", "first"}
