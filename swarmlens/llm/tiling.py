"""Benchmark decontamination (1): greedy string tiling with running Karp-Rabin.

Benchmark items are cut into blocks of bounded size; a block's seeds (hashes
of ``seed`` words in a row) go to every task, and documents are joined with
them by hash where they are read, so texts are never shuffled.  An item that
tiles cover far enough has a certain number of its seeds in the document, so
of its seeds only the rarest are looked up, as many as make it sure that one of
them is hit: a seed that many items share finds no candidates.  For a document
and a candidate, tiles are marked greedily: the longest common run of unmarked
words first, found by Karp-Rabin hashes of a length that starts long and
shrinks to the seed length, then the next longest, until none of ``seed`` words
is left.  Equal tiles are marked in the order of their places in the document,
then in the item; words are compared when a tile is marked.  Tiles don't
overlap on either side and may lie in any order, so reordered passages count.
A document is contaminated by an item if its tiles cover at least ``coverage``
of the item's words.  An item of fewer than ``seed`` words is one seed: it has
to occur whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.rows import without
from swarmlens.llm.wordhash import blocks, power_tables, windows, words

SEED = 5  #: words of the shortest tile
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000  #: benchmark words that a task holds at once, at most (about 100 MB)


def tiles(doc: np.ndarray, item: np.ndarray, seed: int, least: float = 0) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length) of two word-hash arrays, longest first.

    None are looked for if fewer than ``least`` words of the item are in common seeds.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    # only words in a common seed can be in a tile
    for mine, other, free in ((doc, item, free_doc), (item, doc, free_item)):
        reach = np.zeros(len(mine) + 1, np.int64)
        at = np.flatnonzero(np.isin(_rolled(mine, seed), _rolled(other, seed))) if len(mine) >= seed <= len(other) else np.zeros(0, np.int64)
        np.add.at(reach, at, 1)
        np.add.at(reach, at + seed, -1)
        free &= np.cumsum(reach)[:-1] > 0
    found: list[tuple[int, int, int]] = []
    if free_item.sum() < least:
        return found
    length = min(int(free_doc.sum()), int(free_item.sum()))
    while length >= seed:
        length, a, b, hash_a, hash_b = _longest(doc, item, free_doc, free_item, length, seed)
        if length < seed:
            break
        _mark(doc, item, free_doc, free_item, length, a, b, hash_a, hash_b, found)
        length -= 1
    return found


def _mark(doc, item, free_doc, free_item, length, a, b, hash_a, hash_b, found) -> None:
    """Mark the equal runs of one length, from the left; a run that is in the way of one is in the way for good."""
    order = np.argsort(hash_b, kind="stable")
    hash_b, b = hash_b[order], b[order]
    left = np.searchsorted(hash_b, hash_a, "left")
    right = np.searchsorted(hash_b, hash_a, "right")
    hit = np.flatnonzero(right > left)
    pointer: dict[int, int] = {}
    after = 0
    for x, lo, hi in zip(a[hit].tolist(), left[hit].tolist(), right[hit].tolist()):
        if x < after:  # within the last tile of the document
            continue
        k = pointer.get(lo, lo)
        while k < hi:
            y = int(b[k])
            # tiles of this round are equally long, so one in the way holds an end
            if free_item[y] and free_item[y + length - 1]:
                break
            k += 1
        if k < hi and np.array_equal(doc[x : x + length], item[y : y + length]):
            free_doc[x : x + length] = False
            free_item[y : y + length] = False
            found.append((x, y, length))
            after = x + length
            k += 1
        pointer[lo] = k


def _runs(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of ``length`` free places in a row."""
    if len(free) < length:
        return np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[length:] - total[:-length] == length)


def _longest(doc, item, free_doc, free_item, at_most: int, seed: int) -> tuple:
    """The greatest length up to ``at_most`` with a common free run, the free runs of it and their hashes."""
    low, high, best = seed, at_most, (0, None, None, None, None)
    while low <= high:  # a common run of n words holds one of n - 1
        length = (low + high + 1) // 2
        a, b = _runs(free_doc, length), _runs(free_item, length)
        hash_a, hash_b = _rolled(doc, length)[a] if len(a) else a, _rolled(item, length)[b] if len(b) else b
        if len(a) and len(b) and np.isin(hash_b, hash_a).any():
            best, low = (length, a, b, hash_a, hash_b), length + 1
        else:
            high = length - 1
    return best


def _rolled(code: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length``, from running sums modulo 2**64."""
    power, inverse = power_tables(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[: len(code)], out=total[1:])
    run = total[length:] - total[: len(total) - length]
    return run * inverse[: len(run)]


class _Items:
    """Benchmark items of a block with the seeds they are looked up by, by width and in order of hash."""

    def __init__(self, ids: list[int], texts: list[str], seed: int, coverage: float):
        self.ids = ids
        w = words(texts)
        self.words = [w.hash[w.offset[k] : w.offset[k + 1]] for k in range(len(ids))]
        self.width = [min(seed, len(x)) for x in self.words]
        codes = [windows(x, n) if n else np.zeros(0, np.uint64) for x, n in zip(self.words, self.width)]
        known, times = np.unique(np.concatenate([*codes, np.zeros(0, np.uint64)]), return_counts=True)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({n for n in self.width if n}):
            picked, owner = [], []
            for k, code in enumerate(codes):
                if self.width[k] == width:
                    # tiles over s seeds cover at most s * width words
                    least = max(1, int(np.ceil(coverage * len(self.words[k]) / width)))
                    rare = np.argsort(times[np.searchsorted(known, code)], kind="stable")[: len(code) - least + 1]
                    picked.append(np.unique(code[rare]))
                    owner.append(np.full(len(picked[-1]), k))
            code, who = np.concatenate(picked), np.concatenate(owner)
            order = np.argsort(code, kind="stable")
            code = code[order]
            marked = np.zeros(1 << 20, bool)
            marked[(code >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[width] = code, who[order], marked

    def candidates(self, w) -> list[tuple[int, int]]:
        """(text, item) of the texts of ``w`` that have one of the seeds of an item."""
        pairs: list[np.ndarray] = []
        for width, (code, owner, marked) in self.seeds.items():
            met = windows(w.hash, width)
            where = np.flatnonzero(marked[(met >> np.uint64(44)).astype(np.int64)])
            doc = np.searchsorted(w.offset, where, "right") - 1
            inside = where + width <= w.offset[doc + 1]
            # a seed counts once in a text, however often it stands there
            doc, met = np.unique(np.stack((doc[inside].astype(np.uint64), met[where[inside]])), axis=1) if inside.any() else (np.zeros(0, np.uint64),) * 2
            left, right = np.searchsorted(code, met, "left"), np.searchsorted(code, met, "right")
            doc = np.repeat(doc.astype(np.int64), right - left)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)
            pairs.append(np.unique(np.stack((doc, owner[at])), axis=1) if len(doc) else np.zeros((2, 0), np.int64))
        return list(zip(*np.concatenate(pairs, axis=1).tolist())) if pairs else []


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, tiles, matched_words, item_words, coverage) of the contaminated documents, by item.

    Only pairs at or above ``coverage`` are listed.  Null or empty texts and
    items match nothing, nor do items of a null item_id; a null doc_id is kept;
    an item of fewer than ``seed`` words has to occur whole; texts of any
    length are read whole; repeated rows of documents, and of items, give
    repeated rows; empty tables give no rows; other columns are not looked at.
    """
    schema = "doc_id long, item_id long, tiles long, matched_words long, item_words long, coverage double"
    found = None
    for ids, texts in _item_blocks(benchmark):
        part = _against(docs, _Items(ids, texts, seed, coverage), seed, coverage, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of items of at most BLOCK_WORDS words, or of one item; read one partition at a time."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        n = len(row["text"]) // 2 + 1
        if ids and size + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def _against(docs: DataFrame, items: _Items, seed: int, coverage: float, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for a, b in blocks(texts):
                w = words(texts[a:b])
                for d, item in items.candidates(w):
                    known = items.words[item]
                    found = tiles(w.hash[w.offset[d] : w.offset[d + 1]], known, items.width[item], coverage * len(known))
                    matched = sum(n for _, _, n in found)
                    if matched >= coverage * len(known):
                        out.append((ids[a + d], items.ids[item], len(found), matched, len(known), matched / len(known)))
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "tiles", "matched_words", "item_words", "coverage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; a doc_id goes if any of its rows goes."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
