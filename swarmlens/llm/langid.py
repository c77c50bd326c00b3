"""Language ID (4) by error-correcting output codes.

Each language has a codeword of bits.  For every bit a binary n-gram
classifier tells the languages with a 1 from those with a 0: the mean over the
text's byte trigrams (A-Z in lower case; runs of bytes that can't be in a word
count as one blank) of the log-odds of the trigram, both sides smoothed.  Its
counts come from all labelled rows in one pass.  Decoding adds up, for every
language, the logistic losses of the bits' margins against its codeword, bits
weighted by the least mean margin they have for a language's own trigrams
(counted over all labelled rows), and takes the least; the
score is the softmax of the negative losses, and the result is ambiguous if
the second language is near.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.scratch import Scratch
from swarmlens.llm.wordhash import blocks

BUCKETS = 1 << 16
HELD = 16  #: languages that a task counts at a time
COMPARED = 1024  #: codewords of which every two are compared; more languages get longer random ones instead
SHARPNESS = 4.0
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of doc_id as text is 2 modulo 4; a null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram, offset of each text); a text is padded with a blank on both sides."""
    raw = [b" " + (t or "").encode() + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    bound = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[bound[:-1]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    data, bound = data[keep].astype(np.uint32), place[bound]
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    n = np.diff(bound)
    offset = np.concatenate(([0], np.cumsum(np.maximum(n - 2, 0))))
    owner = np.repeat(np.arange(len(texts)), np.maximum(n - 2, 0))
    at = bound[owner] + np.arange(len(owner)) - offset[owner]
    return code[at], offset


def codewords(n: int, bits: int = 0) -> np.ndarray:
    """(n, bits) codewords: all splits of the languages up to five of them, far-apart ones for more."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        rows = [c for c in product((0, 1), repeat=n) if c[0] == 0 and any(c)]
        return np.array(rows, np.int8).reshape(len(rows), n).T
    bits = bits or (4 if n <= COMPARED else 8) * int(np.ceil(np.log2(n))) + 7
    rng = np.random.default_rng(20)
    if n > COMPARED:
        table = rng.integers(0, 2, (n, bits)).astype(np.int8)
        table[0], table[1] = 0, 1  # no bit is alike for all
        return table
    best, far = None, -1
    for _ in range(50):
        table = rng.integers(0, 2, (n, bits)).astype(np.int8)
        table[0], table[1] = 0, 1  # no bit is alike for all
        signs = (2 * table - 1).astype(np.float32)
        apart = (bits - signs @ signs.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > far:
            best, far = table, apart.min()
    return best


class OutputCodes:
    """The fitted classifiers: languages, codewords, log-odds (buckets, bits) and weights of bits."""

    def __init__(self, languages: list[str], ones: np.ndarray, shares: np.ndarray):
        """``shares`` (buckets) sums the languages' shares of a trigram, ``ones`` (buckets, bits) those of the languages whose bit is set."""
        self.languages = languages
        self.codes = codewords(len(languages))
        bits = self.codes.shape[1]
        self.odds = np.zeros((BUCKETS, max(1, bits)), np.float32)
        if bits:  # languages count alike
            set_in = self.codes.sum(0, dtype=np.int64)
            zeros = np.maximum(shares[:, None] - ones, 0)
            self.odds[:] = np.log((ones / set_in + 1e-7) / (zeros / (len(languages) - set_in) + 1e-7))
        self.weight = np.ones(max(1, bits)) / max(1, bits)

    def weigh(self, least: np.ndarray) -> None:
        """Weigh the bits by the least margin that each has for any language's own trigrams: how far apart it holds them."""
        if self.codes.shape[1]:
            self.weight = np.clip(least, 0.05, None)
            self.weight = self.weight / self.weight.sum()

    def margins(self, texts: list[str | None]) -> np.ndarray:
        code, offset = trigrams(texts)
        rows = self.odds[code]
        size = np.diff(offset)
        total = np.zeros((len(texts), rows.shape[1]))
        some = size > 0
        if some.any():
            total[some] = np.add.reduceat(rows, offset[:-1][some], axis=0, dtype=np.float64)
        return total / np.maximum(1, size)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0, False) if t and _LETTER.search(t) else ("und", 0.0, True) for t in texts]
        out = []
        margin = SHARPNESS * self.margins(texts)
        # log(1 + exp(-m)) where the bit is set and log(1 + exp(m)) where it isn't differ by m
        weight = self.weight * len(self.weight)
        loss = (np.logaddexp(0, margin) @ weight)[:, None] - (margin * weight) @ self.codes.T
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        for t, c in zip(texts, chance):
            if not t or not _LETTER.search(t):
                out.append(("und", 0.0, True))
                continue
            best, second = np.argsort(-c, kind="stable")[:2]
            out.append((self.languages[best], float(c[best]), bool(c[best] - c[second] < AMBIGUOUS)))
        return out


def fit(docs: DataFrame) -> OutputCodes:
    """Classifiers from every row of ``docs`` (doc_id, text, lang) with a lang that isn't held out.

    All labels are learned that any text with a trigram has; a null or empty
    text teaches nothing.  A null doc_id is not held out; repeated rows count
    as often as they stand.  What reaches the driver is the labels' names and
    BUCKETS times as many numbers as codewords have bits, which grow as the
    logarithm of the labels.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flushed():
            for g, counts in sorted(total.items()):
                bucket = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(counts[bucket])], names=["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            rows = [(t, g) for i, t, g in zip(*(batch.column(k).to_pylist() for k in range(3))) if not held_out(i)]
            texts, langs = [r[0] for r in rows], np.array([r[1] for r in rows], object)
            for a, b in blocks(texts):
                code, offset = trigrams(texts[a:b])
                owner = np.repeat(langs[a:b], np.diff(offset))
                for g in set(langs[a:b]):
                    if g not in total and len(total) >= HELD:
                        yield from flushed()
                    total.setdefault(g, np.zeros(BUCKETS, np.int64))
                    total[g] += np.bincount(code[owner == g], minlength=BUCKETS)
        yield from flushed()

    scratch = Scratch(docs.sparkSession, "languages")
    labelled = docs.where("lang is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # a row a label
    languages = sorted(totals)
    codes, place = codewords(len(languages)), {g: k for k, g in enumerate(languages)}
    size = np.array([totals[g] for g in languages], float)
    bits = codes.shape[1]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket the sum of the languages' shares, and for each bit of those that have it set."""
        held, sums = None, np.zeros(bits + 1)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["bucket", "sums"])

        for batch in batches:
            for g, bucket, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != held:
                    if held is not None:
                        yield row()
                    held, sums = bucket, np.zeros(bits + 1)
                share = n / size[place[g]]
                sums[0] += share
                sums[1:] += share * codes[place[g]]
        if held is not None:
            yield row()

    ordered = counts.repartition("bucket").sortWithinPartitions("bucket", "lang")
    ones, shares = np.zeros((BUCKETS, bits)), np.zeros(BUCKETS)
    for r in ordered.mapInArrow(shared, "bucket int, sums array<double>").collect():  # BUCKETS rows at most
        shares[r["bucket"]], ones[r["bucket"]] = r["sums"][0], r["sums"][1:]
    model = OutputCodes(languages, ones, shares)
    odds = model.odds

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least margin of each bit over the languages of a partition."""
        least, held, margin = None, None, np.zeros(bits)

        def lower(least):
            signed = margin * (2 * codes[place[held]] - 1)
            return signed if least is None else np.minimum(least, signed)

        for batch in batches:
            for g, bucket, n in zip(*(c.to_pylist() for c in batch.columns)):
                if g != held:
                    if held is not None:
                        least = lower(least)
                    held, margin = g, np.zeros(bits)
                margin += n / size[place[g]] * odds[bucket, :bits]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lower(least).tolist()], pa.list_(pa.float64()))], names=["least"])

    if bits:
        by_language = counts.repartition("lang").sortWithinPartitions("lang", "bucket")
        model.weigh(np.min([r["least"] for r in by_language.mapInArrow(own, "least array<double>").collect()], axis=0))  # a row a task
    scratch.drop(counts)
    return model


def identified(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, ambiguous) per row of ``docs`` (doc_id, text).

    Texts that are null or have no letter are ``und`` with score 0; ties go to
    the language first by name; repeated rows give repeated rows; an empty
    table gives no rows, and without labelled rows every text is ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                found = model.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([held_out(i) for i in ids[a:b]]), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found])],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, fit(docs.select("doc_id", "text", "lang")))
