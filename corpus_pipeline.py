"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes the documents its predecessor kept, as a table, and its
decisions take effect: rejected documents go, matched lines leave the texts,
one document of each group of near duplicates stays (the least doc_id),
contaminated documents go, and the last stage gives the identifiers of each
document that is left, with their number and digests.

Of every stage: null and empty texts have no words, so the first stage rejects
them; a null doc_id is a value like any other and rows that repeat a doc_id
stay or go together; columns of other names stay as they are; an empty table
gives an empty table.  The last stage reads doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarmlens.llm import bpe, jaccard_join, line_dedup, quality_crf, tiling
from swarmlens.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_crf.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *bpe.vocabulary(), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: The random field of the first stage is fitted, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # its successor is written, nothing reads it any more
            scratch.drop(before)
        before = docs
    return docs
