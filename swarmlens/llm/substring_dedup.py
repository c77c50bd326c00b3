"""Substring dedup (10): MinHash banding of the paragraphs of texts.

Paragraphs are of two kinds, both of ``PARAGRAPH`` words or more:

- the lines of a text;
- since passages also stand in the middle of lines, runs of ``PARAGRAPH``
  words cut by content: they begin at the words whose three-word hash is least
  in some window of ``WINDOW`` places (winnowing).  A passage of ``PASSAGE``
  words has such a run wherever it stands.

Words are lower-cased.

1.  MinHash over the five-word shingles of lines: BANDS bands of ROWS values.
    At a Jaccard similarity of 0.8 these collide in 0.986 of pairs; of equal
    paragraphs all do.  A run cut by content has one value, its hash: with a
    word changed inside it is below 0.8 whatever the rest, and the runs beside
    the change still match.
2.  The different paragraphs that collide in a band meet in the band's cell,
    where the exact Jaccard similarity of every two of them decides at 0.8.
    Cells of the same paragraphs are one; large cells are dealt into blocks,
    each pair of blocks in a task of its own.  A cell sends on one row for
    each paragraph: a link to its component and the earliest paragraph near it.
3.  Each place of a paragraph is kept or removed for itself: it is removed if
    an earlier place has the paragraph or one near it, so that every word that
    is removed for an equal one has a copy that stays.  Removed paragraphs of
    a text are merged into spans.  Paragraphs of a text that overlap form a
    run; runs with paragraphs that are alike are components, the passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmlens.llm.components import connected, least_reached
from swarmlens.llm.line_dedup import LineWords
from swarmlens.llm.overlaps import common_counts
from swarmlens.llm.scratch import Scratch
from swarmlens.llm.sketch import among, hashed, marked_bits
from swarmlens.llm.wordhash import blocks, mix, windows

U64 = np.uint64
PASSAGE = 51  #: words of the shortest passage that is found in the middle of a line
PARAGRAPH = 24
SHINGLE = 5
BANDS, ROWS = 6, 3
CELL = 512  #: paragraphs of a cell, or of two blocks of one, that are compared in one task
NOBODY = -(1 << 63)


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


_PERMUTE = mix(np.arange(1, 1 + BANDS * ROWS, dtype=U64)) | U64(1)


class Paragraphs:
    """Paragraphs of a block of texts: text, first word, number of words and hash; lines come before runs cut by content."""

    def __init__(self, texts: list[str | None], least: int = PARAGRAPH, passage: int = PASSAGE):
        lines = LineWords(texts)
        w = lines.words
        self.offset = w.offset
        self.shingle = windows(w.hash, SHINGLE)
        long = np.flatnonzero(lines.size >= least)
        n = len(w.hash)
        window = passage - least + 1
        at = np.zeros(0, np.int64)
        if n >= least and n >= window + 2:
            end = np.repeat(w.offset[1:], np.diff(w.offset))  # of each word's text
            three = windows(w.hash, 3)
            low = _sliding(np.minimum, three, window)
            # windows that reach into the next text have no say
            low[np.arange(len(low)) + window + 2 > end[: len(low)]] = 0
            edge = np.zeros(window - 1, U64)
            greatest = _sliding(np.maximum, np.concatenate((edge, low, edge)), window)
            # a place is an anchor if it is the least of some window that holds it
            at = np.flatnonzero(greatest == three)
            at = at[at + least <= end[at]]
        self.lines = len(long)
        self.start = np.concatenate((lines.left[long], at))
        self.size = np.concatenate((lines.size[long], np.full(len(at), least)))
        self.doc = np.searchsorted(w.offset, self.start, "right") - 1
        # runs are named as lines are, so that equal words have equal hashes
        value = (lines.total[at + least] - lines.total[at]) * lines.inverse[at] if len(at) else np.zeros(0, U64)
        self.hash = np.concatenate((lines.hash[long], lines._named(value, self.size[len(long) :])))

    def bands(self) -> np.ndarray:
        """(lines, BANDS) band values."""
        n = self.lines
        out = np.zeros((n, BANDS), U64)
        if n:
            bound = np.stack((self.start[:n], self.start[:n] + np.maximum(self.size[:n] - SHINGLE + 1, 1)), 1).ravel()
            for b in range(BANDS):
                for r in range(ROWS):
                    # shingles are mixed already, so a multiplication by an odd number permutes them well enough
                    value = np.append(self.shingle * _PERMUTE[b * ROWS + r], U64((1 << 64) - 1))
                    out[:, b] = mix(out[:, b] + np.minimum.reduceat(value, bound)[::2] + U64(b + 1))
        return out

    def shingles(self, k: int) -> np.ndarray:
        """The sorted distinct shingles of a line."""
        return np.unique(self.shingle[self.start[k] : self.start[k] + max(1, self.size[k] - SHINGLE + 1)])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(parts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.reshape(-1).view(np.int64)))


def _paragraphs(docs: DataFrame, least: int, passage: int) -> DataFrame:
    """(doc, start, size, hash, bands) of every paragraph; ``start`` counts the text's words from 0, ``bands`` are those of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).fill_null(NOBODY).to_numpy(zero_copy_only=False)
            for a, b in blocks(texts):
                p = Paragraphs(texts[a:b], least, passage)
                bands = np.zeros((len(p.start), BANDS), U64)
                bands[: p.lines] = p.bands()
                offset = np.minimum(np.arange(len(p.start) + 1), p.lines).astype(np.int32) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(offset), pa.array(bands[: p.lines].reshape(-1).view(np.int64)))
                start = (p.start - p.offset[p.doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][p.doc]), pa.array(start), pa.array(p.size.astype(np.int32)), pa.array(p.hash.view(np.int64)), lists],
                    names=["doc", "start", "size", "hash", "bands"],
                )

    return docs.mapInArrow(run, "doc long, start int, size int, hash long, bands array<long>")


def _cells(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, hash, members) of the different lines that collide in a band; cells of the same lines are one."""
    lines = rows.where("size(bands) > 0")
    shared = lines.select("hash", F.explode("bands").alias("band")).groupBy("band").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a < b").select("band")
    shared = scratch.keep(shared, "shared-bands")
    wanted = marked_bits(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(among(wanted, band.view(U64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick // BANDS)), pa.array(band[pick])], names=["hash", "band"])

    entries = lines.select("hash", "bands").mapInArrow(run, "hash long, band long").distinct().join(shared, "band", "left_semi")
    entries = scratch.keep(entries, "band-entries")
    mark = F.struct(F.count("*"), F.min("hash"), F.max("hash"), F.bit_xor(F.xxhash64("hash")), F.bit_xor(F.xxhash64("hash", F.lit(1))))
    cells = entries.groupBy("band").agg(F.xxhash64(mark).alias("cell"), F.count("*").alias("members"))
    cells = scratch.keep(entries.join(cells, "band").groupBy("cell", "hash").agg(F.first("members").alias("members")), "cells")
    scratch.drop(shared, entries)
    return cells


def _sets(docs: DataFrame, needed: DataFrame, scratch: Scratch, least: int, passage: int) -> DataFrame:
    """(hash, shingles) of the lines in ``needed`` (hash, doc): each is read again from a document that has it."""
    some = scratch.keep(needed.select("hash"), "needed-lines")
    wanted = marked_bits(some)
    read = scratch.keep(needed.select(F.xxhash64("doc").alias("h")).distinct(), "needed-documents")
    marked = marked_bits(read)
    scratch.drop(some, read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick = np.flatnonzero(among(marked, hashed(batch.column(0))))
            texts = batch.column(1).take(pa.array(pick)).to_pylist()
            for a, b in blocks(texts):
                p = Paragraphs(texts[a:b], least, passage)
                name, where = np.unique(p.hash[: p.lines], return_index=True)
                where = where[among(wanted, name)]
                yield pa.RecordBatch.from_arrays([pa.array(p.hash[where].view(np.int64)), pa.array([p.shingles(k).tobytes() for k in where], pa.binary())], names=["hash", "shingles"])

    found = docs.select(F.xxhash64(F.coalesce("doc_id", F.lit(NOBODY))).alias("h"), "text").mapInArrow(run, "hash long, shingles binary")
    return scratch.keep(found.join(needed.select("hash"), "hash", "left_semi").dropDuplicates(["hash"]), "line-sets")


_NEAR = "a long, b long, doc long, start int"


def near_in_cell(shingles: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), both ways, of the paragraphs of a cell whose exact Jaccard similarity is 0.8 or more.

    With ``side`` only paragraphs of different sides are compared.
    """
    size = np.array([len(x) for x in shingles])
    shared = common_counts(shingles)
    i, j = np.nonzero(shared)
    both = shared[i, j].astype(np.int64)
    near = 100 * both >= 80 * (size[i] + size[j] - both)
    if side is not None:
        near &= side[i] != side[j]
    return i[near], j[near]


def _decided(group: pd.DataFrame, sides: bool) -> list[tuple]:
    """Rows of _NEAR for the paragraphs of one cell that another is near to: its component and the earliest near it."""
    name = group["hash"].to_numpy()
    place = list(zip(group["doc"].tolist(), group["start"].tolist()))
    i, j = near_in_cell([np.frombuffer(x, U64) for x in group["shingles"]], group["side"].to_numpy() if sides else None)
    if not len(i):
        return []
    root = least_reached(len(name), i, j)
    rank = np.empty(len(name), np.int64)
    by_place = sorted(range(len(name)), key=place.__getitem__)
    rank[by_place] = np.arange(len(name))
    order = np.lexsort((rank[j], i))
    i, j = i[order], j[order]
    top = np.flatnonzero(np.diff(i, prepend=-1))
    return [(int(name[a]), int(name[root[a]]), *place[b]) for a, b in zip(i[top].tolist(), j[top].tolist())]


def _near(cells: DataFrame, about: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, doc, start) of the lines that another of their cell is near to.

    ``about`` has (hash, shingles, doc, start) of each; ``b`` links a's
    component and (doc, start) is the earliest place of the lines near a.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if not len(frame):
                continue
            last = frame["cell"].iloc[-1]  # it may go on
            left = frame[frame["cell"] == last]
            yield rows_of(frame[frame["cell"] != last])
        if left is not None:
            yield rows_of(left)

    def rows_of(frame: pd.DataFrame) -> pa.RecordBatch:
        out = [row for _, group in frame.groupby("cell", sort=False) for row in _decided(group, False)]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "doc", "start"])

    def blocks_of(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_decided(group, bool(group["i"].iloc[0] != group["j"].iloc[0])), columns=["a", "b", "doc", "start"])

    few = cells.where(F.col("members") <= CELL).select("cell", "hash").join(about, "hash").repartition("cell").sortWithinPartitions("cell")
    near = few.select("cell", "hash", "shingles", "doc", "start").mapInArrow(small, _NEAR)
    many = cells.where(F.col("members") > CELL).withColumn("k", F.ceil(2 * F.col("members") / CELL).cast("int"))
    many = many.withColumn("side", F.pmod(F.xxhash64("hash", F.lit(7)), F.col("k")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    many = many.select("cell", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "hash").join(about, "hash")
    dealt = many.groupBy("cell", "i", "j").applyInPandas(blocks_of, _NEAR)
    return scratch.keep(near.unionByName(dealt), "near")


def repeated_passages(docs: DataFrame, scratch: Scratch | None = None, least: int = PARAGRAPH, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, passage, start_word, end_word, n_words, remove) of every passage that two places share.

    ``passage`` names the component, words are counted from 0 and end_word is
    the one after the last.  A paragraph is to be removed if an earlier place,
    by (doc_id, start), has it or one near it; the removed paragraphs of a
    text are merged, and what is left of its runs is listed with ``remove``
    false.  The spans of a text do not overlap.
    Null texts and texts of fewer than ``least`` words have no paragraph;
    texts of any length are read whole; repeated rows of a doc_id share its
    places; a null doc_id is a document before all others; an empty table
    gives no rows; other columns are not looked at.
    """
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    docs = _texts(docs)
    rows = scratch.keep(_paragraphs(docs, least, passage), "paragraphs")
    # a paragraph and itself some words on are one place: two texts are needed, or two places apart
    apart = f"d0 <> d1 or s1 - s0 >= {least}"
    many = rows.groupBy("hash").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("start").alias("s0"), F.max("start").alias("s1")).where(apart).select("hash")
    cells = _cells(rows, scratch)
    close = scratch.keep(cells.select("hash").distinct(), "close")
    colliding = marked_bits(close)

    def near_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(colliding, hashed(batch.column(0)))))

    # places are combined before they are shuffled, so a paragraph that stands everywhere is no hot task
    first = rows.select("hash", "doc", "start").mapInArrow(near_ones, "hash long, doc long, start int")
    first = first.groupBy("hash").agg(F.min(F.struct("doc", "start")).alias("x")).join(close, "hash", "left_semi")
    first = scratch.keep(first.select("hash", "x.doc", "x.start"), "first-places")
    scratch.drop(close)
    sets = _sets(docs, first.select("hash", "doc"), scratch, least, passage)
    near = _near(cells, sets.join(first, "hash"), scratch)
    scratch.drop(cells, sets, first)

    # paragraphs that another place has too, as they are or nearly
    alike = scratch.keep(many.unionByName(near.select(F.col("a").alias("hash"))).distinct(), "alike")
    wanted = marked_bits(alike)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(wanted, hashed(batch.column(3)))))

    places = rows.select("doc", "start", "size", "hash").mapInArrow(held, "doc long, start int, size int, hash long").join(alike, "hash", "left_semi").distinct()
    places = scratch.keep(places, "places")
    scratch.drop(rows, alike)
    # a run is a chain of overlapping paragraphs of one text
    in_text = Window.partitionBy("doc").orderBy("start", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") < F.max(F.col("start") + F.col("size")).over(in_text), 0).otherwise(1)
    counted = places.withColumn("fresh", fresh)
    counted = counted.withColumn("n", F.sum("fresh").over(Window.partitionBy("doc").orderBy("start", "size", "hash").rowsBetween(Window.unboundedPreceding, 0)))
    runs = scratch.keep(counted.select("doc", "start", "size", "hash", F.xxhash64("doc", "n").alias("run")), "runs")
    scratch.drop(places)
    heads = runs.groupBy("hash").agg(F.min(F.struct("doc", "start", "run")).alias("x"))
    nearest = near.groupBy(F.col("a").alias("hash")).agg(F.min(F.struct("doc", "start")).alias("m"))
    heads = scratch.keep(heads.join(nearest, "hash", "left").select("hash", "x", "m"), "heads")
    before = lambda p: (F.col(f"{p}.doc") < F.col("doc")) | ((F.col(f"{p}.doc") == F.col("doc")) & (F.col("start") - F.col(f"{p}.start") >= least))
    judged = runs.join(heads, "hash").select("doc", "start", "size", "run", F.col("x.run").alias("head"), (before("x") | F.coalesce(before("m"), F.lit(False))).alias("gone"))
    judged = scratch.keep(judged, "judged")
    name = heads.select("hash", F.col("x.run").alias("run"))
    links = near.where("a <> b").select("a", "b").distinct().join(name.toDF("a", "ra"), "a").join(name.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    links = links.unionByName(judged.where("run <> head").select(F.col("run").alias("a"), F.col("head").alias("b")))
    roots = connected(links.where("a <> b").distinct(), scratch).toDF("run", "passage")
    # removed paragraphs that touch are one cut of their run
    in_run = Window.partitionBy("run").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    reached = F.max(F.when(F.col("gone"), end)).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("gone") & F.coalesce(F.col("start") > reached, F.lit(True)), 1).otherwise(0)
    parts = judged.withColumn("cut", cut).withColumn("cut", F.when(F.col("gone"), F.sum("cut").over(in_run.rowsBetween(Window.unboundedPreceding, 0))))
    parts = parts.groupBy("doc", "run", "cut").agg(F.min("start").alias("s"), F.max(end).alias("e"))
    cuts = F.sort_array(F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("s", "e"))))
    spans = parts.groupBy("doc", "run").agg(F.min("s").alias("first"), F.max("e").alias("end"), F.bool_or(F.col("cut").isNull()).alias("stays"), cuts.alias("cuts"))
    bounds = F.concat(F.array(F.struct(F.col("first").alias("s"), F.col("first").alias("e"))), "cuts", F.array(F.struct(F.col("end").alias("s"), F.col("end").alias("e"))))
    left = F.expr("transform(if(stays, sequence(0, size(bounds) - 2), array()), i -> struct(bounds[i].e as start_word, bounds[i + 1].s as end_word, false as remove))")
    removed = F.expr("transform(cuts, c -> struct(c.s as start_word, c.e as end_word, true as remove))")
    spans = spans.withColumn("bounds", bounds)
    spans = spans.select("doc", "run", F.inline(F.concat(left, removed))).where("start_word < end_word")
    spans = spans.join(roots, "run", "left").withColumn("passage", F.coalesce("passage", "run"))
    doc_id = F.when(F.col("doc") != NOBODY, F.col("doc")).alias("doc_id")
    return spans.select(doc_id, "passage", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "remove")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
