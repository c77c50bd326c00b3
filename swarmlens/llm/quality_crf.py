"""Quality rules (5): lines labelled content or boilerplate by a linear-chain CRF.

A text's lines with a word form a sequence.  Each line has a few bucketed
features; the conditional random field adds a weight per bucket and label and
one per pair of neighbouring labels.  It is fitted by gradient ascent on the
exact conditional log-likelihood (forward-backward) of a bounded sample of
labelled documents.  The labels are those of documents, so the labels of lines
are latent: they begin as what each line looks like by itself, and after each
fit they are what the field finds most likely, always held to the document's
label - at least ``CONTENT_SHARE`` of the words of a document of quality 1 are
content, fewer of one of quality 0, and the least certain lines give way.

Viterbi decoding labels a document's lines; it is kept if the base rules don't
fail and at least ``CONTENT_SHARE`` of its words are content.

Without labelled documents of both kinds every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.rows import without
from swarmlens.llm.wordhash import Words, blocks, mix, windows, words

U64 = np.uint64
TRAIN_DOCS = 3000  #: labelled documents of each quality that the field is fitted on, at most
PIECE, PIECES = 32, 8  #: a sampled document gives up to PIECES pieces of PIECE lines, spread over it
CONTENT_SHARE = 0.5
_SHARES = np.array([0.02, 0.1, 0.3, 0.6, 0.9])
_LENGTHS = np.array([3, 8, 20, 60])
GROUPS, BUCKETS = 8, 6

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 symbol, 4 digit, 5 exclamation
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 4
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3
_KIND[ord("!")] = 5
_POINT = np.ones(256, bool)  # bytes that begin a code point
_POINT[0x80:0xC0] = False


class Lines:
    """Base counts of a block of texts and features of their lines that have a word."""

    def __init__(self, texts: list[str | None]):
        w = words(texts, lower=False)
        n = len(texts)
        self.n_words = np.diff(w.offset)
        self.word_chars = self._by_text(w, self._running(_POINT[w.data]), w.start, w.end)
        kind = _KIND[w.data]
        counts = {k: self._running(kind == k) for k in range(1, 6)}
        self.n_symbols = counts[3][w.first[1:]] - counts[3][w.first[:-1]]

        repeated = self._repeated(w)
        marked = self._running(repeated)
        self.n_repeat_words = marked[w.offset[1:]] - marked[w.offset[:-1]]

        newline = np.flatnonzero(w.data == 10)
        start = np.sort(np.concatenate((w.first[:-1], newline + 1)))
        end = np.sort(np.concatenate((w.first[1:] - 1, newline)))
        left, right = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = right > left
        start, end, left, right = start[has], end[has], left[has], right[has]
        doc = np.searchsorted(w.first, start, "right") - 1
        self.offset = np.searchsorted(doc, np.arange(n + 1))
        again = self._repeats(w.data, start, end, doc)
        seen = self._running(again)
        self.n_dup_lines = seen[self.offset[1:]] - seen[self.offset[:-1]]

        size = right - left
        self.words = size
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        runs = self._running(same)
        part = {k: c[end] - c[start] for k, c in counts.items()}
        letters = np.maximum(1, part[1] + part[2])
        shares = [
            part[1] / letters,
            part[3] / size,
            part[5] / size,
            part[4] / np.maximum(1, end - start),
            (runs[right] - runs[left]) / size,
            (marked[right] - marked[left]) / size,
        ]
        table = [np.searchsorted(_SHARES, x) for x in shares] + [np.searchsorted(_LENGTHS, size), again.astype(int)]
        self.features = np.stack(table, 1).astype(np.uint8)

    @staticmethod
    def _running(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    @staticmethod
    def _by_text(w: Words, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        per_word = Lines._running(total[end] - total[start])
        return per_word[w.offset[1:]] - per_word[w.offset[:-1]]

    @staticmethod
    def _repeated(w: Words) -> np.ndarray:
        """Words in three-word windows that their text holds twice or more."""
        out = np.zeros(len(w.hash), bool)
        code = windows(w.hash, 3)
        if len(code):
            where = np.arange(len(code))
            doc = w.doc[: len(code)]
            valid = np.flatnonzero(where + 3 <= w.offset[doc + 1])
            key = code[valid] ^ mix(doc[valid].astype(U64) + U64(1))
            order = np.argsort(key)
            key = key[order]
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            at = valid[order[twin]]
            for k in range(3):
                out[at + k] = True
        return out

    @staticmethod
    def _repeats(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a line equals an earlier one of its text, byte by byte."""
        raw, seen, text = data.tobytes(), set(), -1
        out = np.zeros(len(start), bool)
        for k, (a, b, d) in enumerate(zip(start.tolist(), end.tolist(), doc.tolist())):
            if d != text:
                seen, text = set(), d
            line = raw[a:b]
            out[k] = line in seen
            seen.add(line)
        return out


class ChainCRF:
    """Two labels (0 content, 1 boilerplate) over sequences of bucketed features."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((GROUPS, BUCKETS, 2)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(lines, 2) emission scores."""
        return self.emission[np.arange(GROUPS), features].sum(1)

    def posterior(self, flat: np.ndarray, rows: list[np.ndarray], alive: list[int]) -> tuple[np.ndarray, ...]:
        """(score, forward, backward) of all lines of the sequences whose t-th lines are ``rows[t]``, longest sequences first."""
        score = self.scores(flat)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[rows[0]] = score[rows[0]]
        for t in range(1, len(rows)):
            before = forward[rows[t] - 1][:, :, None] + self.transition
            forward[rows[t]] = np.logaddexp(before[:, 0], before[:, 1]) + score[rows[t]]
        for t in range(len(rows) - 2, -1, -1):
            after = (backward[rows[t + 1]] + score[rows[t + 1]])[:, None, :] + self.transition
            backward[rows[t][: alive[t + 1]]] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        return score, forward, backward

    def gradient(self, flat: np.ndarray, true: np.ndarray, rows: list[np.ndarray], alive: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the conditional log-likelihood of the labels ``true``, by emission and by transition."""
        score, forward, backward = self.posterior(flat, rows, alive)
        both = forward + backward
        error = -np.exp(both - np.logaddexp(both[:, 0], both[:, 1])[:, None])
        error[np.arange(len(true)), true] += 1
        gain = np.zeros_like(self.emission)
        for g in range(GROUPS):
            for label in (0, 1):
                gain[g, :, label] = np.bincount(flat[:, g], error[:, label], BUCKETS)
        turn = np.zeros((2, 2))
        for t in range(1, len(rows)):
            at = rows[t]
            pair = forward[at - 1][:, :, None] + self.transition + (score[at] + backward[at])[:, None, :]
            pair -= np.logaddexp.reduce(pair.reshape(len(at), 4), axis=1)[:, None, None]
            turn -= np.exp(pair).sum(0)
            turn += np.bincount(2 * true[at - 1] + true[at], minlength=4).reshape(2, 2)
        return gain, turn

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 40, ridge: float = 1.0, rate: float = 0.3) -> ChainCRF:
        """Gradient ascent (Adagrad) on the penalised conditional log-likelihood of the lines' labels."""
        order, flat, rows, alive = _laid_out(sequences)
        true = np.concatenate([labels[k] for k in order]).astype(np.int64)
        seen_e, seen_t = np.zeros_like(self.emission), np.zeros_like(self.transition)
        for _ in range(rounds):
            gain, turn = self.gradient(flat, true, rows, alive)
            gain -= ridge * self.emission
            turn -= ridge * self.transition
            seen_e += gain**2
            seen_t += turn**2
            self.emission = self.emission + rate * gain / np.sqrt(seen_e + 1e-9)
            self.transition = self.transition + rate * turn / np.sqrt(seen_t + 1e-9)
        return self

    def fit_latent(self, sequences: list[np.ndarray], sizes: list[np.ndarray], quality: list[int], passes: int = 3) -> ChainCRF:
        """Fit to labels of documents: ``sizes`` are the words of the lines, ``quality`` is 1 or 0 a sequence."""
        order, flat, rows, alive = _laid_out(sequences)
        ends = np.cumsum([len(sequences[k]) for k in order])
        for step in range(passes + 1):
            if step == 0:  # lines by themselves, each with its document's label
                alone = [s[k : k + 1] for s in sequences for k in range(len(s))]
                self.fit(alone, [np.array([1 - q]) for s, q in zip(sequences, quality) for _ in range(len(s))])
                self.transition[:] = 0
            _, forward, backward = self.posterior(flat, rows, alive)
            margin = (forward + backward) @ np.array([-1.0, 1.0])  # above 0: boilerplate
            labels: list[np.ndarray] = [np.zeros(0)] * len(sequences)
            for k, part in zip(order, np.split(margin, ends[:-1])):
                labels[k] = _held_to(part, sizes[k], quality[k])
            if step < passes:
                self.fit(sequences, labels)
        return self

    def viterbi(self, score: np.ndarray) -> list[int]:
        """The best labels of one sequence; ties go to content."""
        (a, b), (c, d) = self.transition.tolist()
        back = []
        x = y = None
        for u, v in score.tolist():
            if x is None:
                x, y = u, v
                continue
            to_x, to_y = x + a, y + c
            from_x, from_y = x + b, y + d
            back.append((to_y > to_x, from_y > from_x))
            x, y = max(to_x, to_y) + u, max(from_x, from_y) + v
        if x is None:
            return []
        label = int(y > x)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]


def _laid_out(sequences: list[np.ndarray]) -> tuple:
    """(order, lines, rows, alive): the lines of the sequences, longest first, and the t-th lines of all that have one."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    size = np.array([len(sequences[k]) for k in order])
    flat = np.concatenate([sequences[k] for k in order])
    starts = np.cumsum(size) - size
    alive = [int((size > t).sum()) for t in range(size.max())]
    return order, flat, [starts[:n] + t for t, n in enumerate(alive)], alive


def _held_to(margin: np.ndarray, size: np.ndarray, quality: int) -> np.ndarray:
    """Labels by the sign of ``margin``, with the least certain lines turned until the share of content suits ``quality``."""
    label = (margin > 0).astype(np.int64)
    wrong = 0 if quality == 0 else 1  # the label that has too many words
    words_ = size.sum()
    for k in np.argsort(np.where(label == wrong, np.abs(margin), np.inf), kind="stable"):
        share = size[label == 0].sum() / words_
        if (share >= CONTENT_SHARE) == (quality == 1):
            break
        label[k] = 1 - label[k]
    return label


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ChainCRF:
    """The field fitted on up to ``train_docs`` labelled documents of each quality, taken by a hash of doc_id.

    Each gives up to PIECES pieces of PIECE lines.  Null doc_ids, null texts
    and other qualities are left out; the greater of contradicting labels holds;
    rows that repeat a doc_id are documents each; without rows of both
    qualities the field is flat.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for quality in (0, 1):
        some = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        picked = some if picked is None else picked.unionByName(some)
    sample = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(picked), "doc_id")  # 2 * train_docs rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, quality = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                lines = Lines(texts[a:b])
                rows = []
                for k in range(b - a):
                    left, right = lines.offset[k], lines.offset[k + 1]
                    pieces = -(-(right - left) // PIECE)
                    for p in sorted({pieces * j // PIECES for j in range(PIECES)}) if pieces else ():
                        some = slice(left + p * PIECE, min(right, left + (p + 1) * PIECE))
                        rows.append((lines.features[some].tobytes(), lines.words[some].astype("<i8").tobytes(), quality[a + k]))
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32())], names=["features", "words", "quality"])

    rows = sample.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "features binary, words binary, quality int")
    rows = sorted(rows.collect(), key=lambda r: (r["quality"], r["features"], r["words"]))  # 2 * train_docs * PIECES rows at most
    if len({r["quality"] for r in rows}) < 2:
        return ChainCRF()
    sequences = [np.frombuffer(r["features"], np.uint8).reshape(-1, GROUPS) for r in rows]
    return ChainCRF().fit_latent(sequences, [np.frombuffer(r["words"], "<i8") for r in rows], [r["quality"] for r in rows])


def judged(docs: DataFrame, crf: ChainCRF, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed``, ``content_share`` and ``kept``.

    A null or empty text has no words, fails the base rules and has a content
    share of 0; repeated rows give repeated rows; an empty table gives no rows;
    other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                lines = Lines(texts[a:b])
                score = crf.scores(lines.features)
                share = np.zeros(b - a)
                for k in range(b - a):
                    left, right = lines.offset[k], lines.offset[k + 1]
                    if right > left:
                        good = np.array(crf.viterbi(score[left:right])) == 0
                        share[k] = lines.words[left:right][good].sum() / lines.words[left:right].sum()
                failed = (lines.n_words < 50) | (100 * lines.n_repeat_words > 50 * lines.n_words)
                counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(share)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; a doc_id goes if any of its rows goes."""
    return without(docs, judged(docs, fit(docs, labels)).where("not kept").select("doc_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
