"""Token counts (9): a separator scan over flat token files that have no index.

A token file is little-endian unsigned 16-bit identifiers; each document is
followed by the end-of-document identifier and nothing else says where it ends.
Files are read in blocks of bounded size, wherever those fall.  A block finds
its separators with one vectorised comparison and reports each one's place;
what it can't know - how many documents ended before it, and where the
document at its head began - comes from a prefix scan over the blocks' summary
(separators so far, last separator so far), one short row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmlens.llm.bpe import encoder, vocabulary
from swarmlens.llm.scratch import Scratch

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Token files of ``docs`` (doc_id, text) in ``folder``, one for each task.

    Gives (file, ordinal, doc_id): which document stands where, and the file's
    size on the row of its first one.  Texts hold no separator: the vocabulary
    has no token of that number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        # each attempt has a file of its own, so a task that runs again leaves nothing half-written in use
        name = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, place = fs.FileSystem.from_uri(name)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        bpe = encoder(path, pattern)
        end = np.array([separator], "<u2").tobytes()
        ids: list = []
        size = 0
        with system.open_output_stream(place) as out:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    tokens = bpe.encode(text.as_py() or "")
                    if len(tokens) and int(tokens.max()) > 0xFFFF:
                        raise ValueError("identifiers of more than 16 bits don't fit a token file")
                    data = tokens.astype("<u2").tobytes() + end
                    out.write(data)
                    size += len(data)
                    ids.append(i)
        sizes = [size] + [None] * (len(ids) - 1) if ids else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())],
            names=["file", "ordinal", "doc_id", "bytes"],
        )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "file string, ordinal long, doc_id long, bytes long")


def scan(files: DataFrame, scratch: Scratch, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in ``files`` (file, bytes), counted without its separator.

    Tokens after a file's last separator are a last document; half a token at
    the end of a file is none; an empty file and an empty table have none.
    """
    step = 2 * block_tokens
    whole = files.select("file", F.expr("bytes - bytes % 2").alias("bytes")).where("bytes > 0")
    parts = whole.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))))
    parts = parts.repartition("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["file"])
                with system.open_input_file(place) as data:
                    ids = np.frombuffer(data.read_at(min(step, row["bytes"] - row["start"]), row["start"]), "<u2")
                ends = np.flatnonzero(ids == separator) + row["start"] // 2
                if row["start"] + step >= row["bytes"] and (not len(ids) or ids[-1] != separator):
                    ends = np.append(ends, row["bytes"] // 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["start"]], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "start", "n", "last", "ends"],
                )

    found = parts.select("file", "bytes", "start").mapInArrow(run, "file string, start long, n long, last long, ends array<long>")
    found = scratch.keep(found, "blocks")
    # the scan over blocks carries their summaries only
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select(
        "file",
        "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    stitched = found.select("file", "start", "ends").hint("merge").join(summary, ["file", "start"])
    lengths = F.transform("ends", lambda end, k: end - F.when(k == 0, F.col("previous")).otherwise(F.get("ends", k - 1)) - 1)
    each = stitched.select("file", "skipped", F.posexplode(lengths).alias("k", "n_tokens"))
    return each.select("file", (F.col("skipped") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str, pattern: str, scratch: Scratch | None = None) -> DataFrame:
    """One row (doc_id, n_tokens) per row of ``docs`` (doc_id, text), by scanning its token files.

    A null text is an empty document of no tokens; a null doc_id is kept;
    repeated rows are counted each; texts of any length are written whole and
    scanned in blocks; an empty table gives no rows; other columns are not
    looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    written = scratch.keep(write_token_files(docs, scratch.path("files"), path, pattern), "manifest")
    counts = scan(written.where("bytes is not null").select("file", "bytes"), scratch)
    # both sides grow with the documents, so neither is broadcast
    return written.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary()).select("doc_id", "n_tokens")
