"""Mentions of very many names in very many texts: a substring join without a nested loop.

A name can only be in a text that has all the name's pieces of ``width``
characters, so each name is looked up by one of them, the one that the fewest
texts have: names and texts meet by an equality join on hashes of pieces, and
``contains`` confirms.  Names shorter than that meet pieces of their own
length, which are the names themselves.

Texts have very many pieces, and nearly all are in no name.  A filter of a
fixed size, which every task gets, has the hashes of the names' pieces; pieces
that it doesn't know are dropped where they are cut, and in the same way texts
that no name's rarest piece is in, before texts are shuffled.  It errs to the safe side
only: what passes by chance meets nothing.  Both sides are shuffled by piece,
so neither has to fit anywhere, and a piece of very many texts is used only by
names that have no rarer one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.sources.folders import work_folder

WIDTH = 8
BITS = 27  #: the filter has two to this many bits, 16 MB
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 22  #: characters that are cut at once


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h & np.uint64((1 << BITS) - 1)).astype(np.int64), (h >> np.uint64(64 - BITS)).astype(np.int64)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have both their bits set."""
    first, second = _places(h)
    return (bits[first >> 3] >> (first & 7).astype(np.uint8)) & (bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1


def _hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every piece of ``width`` characters of the texts, which overlap."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(len(points) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * BASE + points[k : k + len(h)]
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[: len(h)] == row[width - 1 :]  # no piece of two texts
    return row[: len(h)][inside], _mixed(h[inside])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, the last column, by slices of about SLICE characters, with the place of the first."""
    texts, low, size = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or k == len(texts) - 1:
            yield low, texts[low : k + 1]
            low, size = k + 1, 0


def _cut(rows: DataFrame, widths: Callable[[str], int] | list[int], known: np.ndarray | None = None) -> DataFrame:
    """(key, piece): hashes of the distinct pieces of ``rows`` (key, text), of those that the filter ``known`` may have."""
    shared = None if known is None else rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for low, texts in _slices(batch):
                if callable(widths):
                    groups: dict[int, list[int]] = {}
                    for k, t in enumerate(texts):
                        groups.setdefault(widths(t), []).append(k)
                else:
                    groups = {w: list(range(len(texts))) for w in widths}
                for width, places in groups.items():
                    row, h = _hashes([texts[k] for k in places], width)
                    if bits is not None:
                        keep = _known(bits, h)
                        row, h = row[keep], h[keep]
                    if not len(h):
                        continue
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
                    at = pa.array(np.array(places, np.int64)[row[new]] + low)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(h[new].view(np.int64))], names=["key", "piece"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece long")


def _filter(pieces: DataFrame) -> np.ndarray:
    """The bits of all hashes; tasks send the bytes they set, which are merged by place first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for batch in batches:
            for places in _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        page = bits.reshape(-1, 4096)
        for k in np.nonzero(page.any(1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([page[k].tobytes()], pa.binary())], names=["page", "bits"])

    def merged(key: tuple, pages: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce(np.frombuffer(b"".join(pages.column("bits").to_pylist()), np.uint8).reshape(-1, 4096), axis=0)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    set_ = pieces.select("piece").mapInArrow(run, "page int, bits binary").groupBy("page").applyInArrow(merged, "page int, bits binary")
    bits = np.zeros((1 << (BITS - 3)) // 4096 * 4096, np.uint8).reshape(-1, 4096)
    for r in set_.toLocalIterator():  # 16 MB at most
        bits[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def _with_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``rows`` (key, ..) whose key one of ``candidates`` may have, so that no other text is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter(candidates.select(F.col("key.a").alias("piece"))))

    @F.pandas_udf("boolean")
    def known(a: pd.Series) -> pd.Series:
        return pd.Series(_known(shared.value, a.to_numpy().view(np.uint64)))

    return rows.where(known("key.a"))


def _met(names: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(low, key, copies) of every name in every different text; names by low, and the texts' ids by key."""
    spark = names.sparkSession
    folder = work_folder(spark, "mentions")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    wanted = names.select("name_id", F.lower("name").alias("low")).where("low <> ''")
    patterns = wanted.select("low").distinct()
    key = F.struct(F.xxhash64("text_low").alias("a"), F.xxhash64("text_low", F.lit(1)).alias("b"))  # 128 bits
    rows = texts.select("text_id", F.lower("text").alias("text_low")).where("text_low <> ''").withColumn("key", key)
    # a short name is its own piece, so the lengths of short names are the other widths to cut: fewer than ``width``
    short = sorted(r["n"] for r in patterns.where(F.length("low") < width).select(F.length("low").alias("n")).distinct().collect())
    options = kept(_cut(patterns.select(F.col("low").alias("key"), "low"), lambda t: min(width, len(t))).withColumnRenamed("key", "low"), "options")

    number = F.struct(F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    cut = _cut(rows.select(F.concat_ws(" ", number["a"], number["b"]).alias("key"), "text_low"), [*short, width], _filter(options))
    a, b = (F.split_part("key", F.lit(" "), F.lit(k)).cast("long") for k in (1, 2))
    pieces = kept(cut.select(F.struct(a.alias("a"), b.alias("b")).alias("key"), "piece"), "pieces")

    often = pieces.groupBy("piece").agg(F.count("*").alias("often"))
    # a piece that no text has is the rarest: such a name is nowhere
    rarest = options.join(often, "piece", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece")).alias("best"))
    lookup = rarest.where("best.often > 0").select("low", F.col("best.piece").alias("piece"))
    candidates = kept(pieces.join(lookup, "piece").select("low", "key").distinct(), "candidates")
    rows = _with_candidates(rows, candidates)
    bodies = rows.groupBy("key").agg(F.first("text_low").alias("text_low"), F.count("*").alias("copies"))  # texts repeat; each is searched once
    met = candidates.join(bodies, "key").where(F.contains("text_low", "low"))
    return met.select("low", "key", "copies"), wanted, rows.select("key", "text_id")


def mentions(names: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(name_id, text_id): which of ``texts`` (text_id, text) hold which of ``names`` (name_id, name), case aside.

    Null and empty names are mentioned nowhere, null texts mention nothing;
    equal names and equal texts meet once and are told apart at the end.
    """
    met, wanted, rows = _met(names, texts, width)
    return met.join(wanted, "low").join(rows, "key").select("name_id", "text_id")


def mention_counts(names: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(name_id, n_texts) of every row of ``names``: how many rows of ``texts`` hold it; 0 where none does."""
    met, _, _ = _met(names, texts, width)
    counted = met.groupBy("low").agg(F.sum("copies").alias("n"))
    found = names.select("name_id", F.lower("name").alias("low")).join(counted, "low", "left")
    return found.select("name_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_texts"))
