"""LM scoring (8): a hierarchical Pitman-Yor model over all training tokens.

The restaurants: one for each previous word (or the start of a text), whose
parent is that of the word's last byte, whose parent is the restaurant of words
without context, whose base is uniform over the known words and one for all
unknown ones.  A word's customers in a context sit at tables; each table is a
customer of the parent.  The contexts grow with the corpus.

Training counts (word, previous word) pairs; they are split by word hash into
buckets, so that a word's customers in all contexts and in their parents meet in
one bucket.  What a context has over all words is added up in other buckets, by
context, and sent back to the buckets that asked.  A Gibbs sweep takes every
pair's customers out of its restaurant, and their tables' customers out of the
parents, and draws its number of tables anew from its distribution given the
rest; then the tables' customers in the parents likewise.  Pairs of one word in
different contexts, and words in different buckets, are drawn side by side, so
they see each other as the last sweep left them.  After a burn-in the predictive
probabilities of the samples are averaged.

Scoring: a block of texts asks each bucket of words for the pairs it holds and
each bucket of contexts for its contexts, gets customers, tables, the parents'
probabilities and training counts in the order it asked, and adds up the
averaged predictions for its texts.  Keys travel as compressed arrays, one row for each
block and bucket.  Words are 56-bit hashes, as contexts they are cut to 40 bits.
Documents are scored in rounds, so that the shuffle files of one are gone before
the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.llm.scratch import Scratch
from swarmlens.llm.wordhash import blocks, mix, words

U64 = np.uint64
END = U64(0xE5D0_0000_0000_0000 | 0x17 << 8)  # the word hash of the end of a text
START_CONTEXT = 0
BLOCK_CHARS = 3_000_000  #: texts of about so many characters ask together
BUCKET_BYTES = 4_000_000  #: input bytes for each bucket of words
BURN_IN, SAMPLES = 1, 2
ROUNDS = 2  #: rounds of scoring, where there is more than one bucket
CONTEXT = U64(0xFFFF_FFFF_FF00_0000)  #: bits of a word's hash that name it as a context
STRENGTH = 1.0


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of doc_id as text is 1 modulo 5; a null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@lru_cache(maxsize=1)
def _codec() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, plane by plane."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return _codec()[0].compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(_codec()[1].decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=U64)


def types_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every token, offset of each text): the high 56 bits are the word, the low 8 its context."""
    w = words(texts)
    n = np.diff(w.offset) + 1
    offset = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(offset[-1], U64)
    is_end = np.zeros(len(out), bool)
    is_end[offset[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = w.hash & ~U64(0xFF)
    last = np.zeros(len(out), U64)
    last[np.flatnonzero(~is_end) + 1] = w.data[w.end - 1].astype(U64)  # the token after a word
    last[offset[:-1]] = START_CONTEXT
    return out | last, offset


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, previous word, offset): the keys of ``types_of``, and the context hash of the word before, 0 at the start of a text."""
    key, offset = types_of(texts)
    before = np.concatenate((key[:1], key[:-1])) & CONTEXT
    before[offset[:-1]] = 0
    return key, before, offset


def _sorted_pairs(key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): the order by key, then context, and where each different pair begins in it."""
    order = np.argsort(key)
    found = key[order]
    rank = np.cumsum(np.concatenate(([0], (found[1:] != found[:-1]).astype(np.int64)))) if len(key) else np.zeros(0, np.int64)
    if len(key) and rank[-1] >= 1 << 24:
        order = np.lexsort((before, key))
        fresh = (key[order][1:] != key[order][:-1]) | (before[order][1:] != before[order][:-1])
    else:
        code = _composite(rank, before[order])
        inner = np.argsort(code)
        order, code = order[inner], code[inner]
        fresh = code[1:] != code[:-1]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), fresh)))


def _composite(rank: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number for the rank of a key (below 2**24) and a context."""
    return (rank.astype(U64) << U64(40)) | (before >> U64(24))


def _round_of(block: int, rounds: int) -> int:
    """Blocks of a task, and first blocks of tasks, take turns."""
    return ((block >> 24) + (block & 0xFFFFFF)) % rounds


def _whole(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pairs_of`` of many texts, made in parts."""
    keys, befores, ends = [], [], [np.zeros(1, np.int64)]
    for a, b in blocks(texts):
        key, before, offset = pairs_of(texts[a:b])
        keys.append(key)
        befores.append(before)
        ends.append(offset[1:] + ends[-1][-1])
    return np.concatenate(keys), np.concatenate(befores), np.concatenate(ends)


def _unique_pairs(texts: list) -> tuple[np.ndarray, ...]:
    """(key, previous word, count) of the pairs of ``texts``, by key and previous word."""
    key, before, _ = _whole(texts)
    order, start = _sorted_pairs(key, before)
    at = order[start]
    return key[at], before[at], np.diff(start, append=len(key))


def _merged(key: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order, start = _sorted_pairs(key, before)
    at = order[start]
    return key[at], before[at], np.add.reduceat(n[order], start).astype(np.int64)


def _buckets_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of sorted ``keys``."""
    if not len(keys):
        return []
    bucket = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    start = np.concatenate(([0], cut))
    return list(zip(bucket[start].tolist(), start.tolist(), [*cut.tolist(), len(keys)]))


def _text_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list]]:
    """(block id, doc_ids, texts) of a task's rows; the same for every read of the same partition."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = len(t) if t else 0
            if ids and size + n > limit:
                yield number, ids, texts
                number += 1
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n + 1
    if ids:
        yield number, ids, texts


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """The state of each bucket's training pairs, each at one table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in _text_blocks(batches, BLOCK_CHARS):
            train = [t for i, t in zip(ids, texts) if not held_out(i)]
            if not train:
                continue
            keys, before, n = _unique_pairs(train)
            n = n.astype("<u4")
            rows = _buckets_of(keys, bits)
            columns = [[pack_sorted(keys[a:b]) for _, a, b in rows], [pack(before[a:b]) for _, a, b in rows], [pack(n[a:b]) for _, a, b in rows]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "keys", "before", "counts"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_sorted(x) for x in group["keys"]])
        before = np.concatenate([unpack(x, "<u8") for x in group["before"]])
        pairs = Pairs(*_merged(keys, before, np.concatenate([unpack(x, "<u4") for x in group["counts"]]).astype(np.int64)))
        return pairs.row(int(group["bucket"].iloc[0]), np.zeros(0, np.int64), pairs.one_table())

    return docs.mapInArrow(count, "bucket int, keys binary, before binary, counts binary").groupBy("bucket").applyInPandas(merge, _STATE)


_STATE = "bucket int, keys binary, before binary, counts binary, tables binary, shared array<double>"


class Bucket:
    """The types of a bucket of words: keys in order, customers, and the word each belongs to."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray):
        self.keys, self.customers = keys, customers.astype(np.int64)
        self.context = (keys & U64(0xFF)).astype(np.int64)
        word = keys & ~U64(0xFF)
        self.first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        self.words = word[self.first]
        self.word = np.cumsum(np.concatenate(([True], word[1:] != word[:-1]))) - 1
        self.counts = np.add.reduceat(self.customers, self.first)

    def one_table(self) -> tuple[np.ndarray, np.ndarray]:
        """The first seating: one table for each type, in contexts and in the parent."""
        return np.ones(len(self.keys), np.int64), np.ones(len(self.words), np.int64)

    def shared(self, tables: tuple[np.ndarray, np.ndarray]) -> list[float]:
        """What this bucket adds to the numbers that all buckets share."""
        below, top = tables
        sizes = [np.bincount(self.context, x, 256) for x in (self.customers, below)]
        once = [np.sum(self.customers == 1), np.sum(self.customers == 2)]
        words_with = np.bincount(self.word)
        top_once = [np.sum(words_with == 1), np.sum(words_with == 2)]
        return [*sizes[0], *sizes[1], below.sum(), top.sum(), len(self.words), self.customers.sum(), *once, *top_once]


class Pairs:
    """The (word, previous word) pairs of a bucket in order, with the bucket of the types they back off to."""

    def __init__(self, keys: np.ndarray, before: np.ndarray, customers: np.ndarray):
        self.keys, self.before, self.customers = keys, before, customers.astype(np.int64)
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.first = np.flatnonzero(fresh)
        self.type = np.cumsum(fresh) - 1
        self.types = self.above(np.ones(len(keys), np.int64))
        counts = np.add.reduceat(self.customers, self.first)
        self.counts = np.add.reduceat(counts, self.types.first)  # of each word

    @cached_property
    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        """(contexts in order, which of them each pair has)."""
        order = np.argsort(self.before)
        found = self.before[order]
        fresh = np.concatenate(([True], found[1:] != found[:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        return found[fresh], which

    @cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray | None]:
        """(a number of each pair, ascending; the pairs in that order, None if it is theirs): once for all blocks that ask."""
        if len(self.types.keys) < 1 << 24:
            return _composite(self.type, self.before), None
        own = mix(self.type.astype(U64) + mix(self.before))
        order = np.argsort(own)
        return own[order], order

    def places(self, types: np.ndarray, of: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, seen) among the pairs of other ones: ``types`` are places among the types, -1 if unseen, ``of`` which of them each has."""
        rank = types[of]
        own, order = self.numbers
        other = _composite(np.maximum(rank, 0), before) if order is None else mix(rank.astype(U64) + mix(before))
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        return at if order is None else order[at], (own[at] == other) & (rank >= 0)

    @classmethod
    def of(cls, row) -> Pairs:
        return cls(unpack_sorted(row["keys"]), unpack(row["before"], "<u8"), unpack(row["counts"], "<i8"))

    def above(self, tables: np.ndarray) -> Bucket:
        """The types, whose customers are the tables of the pairs."""
        return Bucket(self.keys[self.first], np.add.reduceat(tables, self.first))

    def one_table(self) -> tuple[np.ndarray, ...]:
        return np.ones(len(self.keys), np.int64), *self.types.one_table()

    def split(self, kept: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tables of pairs, types and words of one seating."""
        a, b = len(self.keys), len(self.keys) + len(self.first)
        return kept[:a], kept[a:b], kept[b:]

    def row(self, bucket: int, kept: np.ndarray, seating: tuple[np.ndarray, ...]) -> pd.DataFrame:
        """A row of the state whose last seating is ``seating``."""
        tables, below, top = seating
        once = [np.sum(self.customers == 1), np.sum(self.customers == 2)]
        shared = [*self.above(tables).shared((below, top)), self.customers.sum(), *once]
        kept = np.concatenate([kept, *seating])
        columns = {"bucket": bucket, "keys": pack_sorted(self.keys), "before": pack(self.before), "counts": pack(self.customers), "tables": pack(kept)}
        return pd.DataFrame({k: [v] for k, v in columns.items()} | {"shared": [[float(x) for x in shared]]})


class Shared:
    """Numbers over all buckets: customers and tables of contexts and parent, sizes, and discounts."""

    def __init__(self, total: np.ndarray):
        self.customers, self.tables = total[:256], total[256:512]
        self.parent_customers, self.parent_tables, self.words, self.tokens = total[512:516]
        # counts of types seen once and twice give the discounts, as in Kneser-Ney smoothing
        self.discount = min(0.95, max(0.05, (total[516] + 0.5) / (total[516] + 2 * total[517] + 1)))
        self.parent_discount = min(0.95, max(0.05, (total[518] + 0.5) / (total[518] + 2 * total[519] + 1)))
        if len(total) > 520:  # the pairs above whose restaurants these are
            self.tokens = total[520]
            self.pair_discount = min(0.95, max(0.05, (total[521] + 0.5) / (total[521] + 2 * total[522] + 1)))

    def unknown(self) -> float:
        """The parent's probability of a word without a table."""
        return (STRENGTH + self.parent_discount * self.parent_tables) / (STRENGTH + self.parent_customers) / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.parent_discount * tables) / (STRENGTH + self.parent_customers) + self.unknown()

    def parent_less(self, arrived: np.ndarray, top: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """The parent's probability of words of ``arrived`` customers at ``top`` tables, without ``gone`` of the customers."""
        left = arrived - gone
        kept = np.minimum(top, left)
        room = STRENGTH + self.parent_customers - gone
        fresh = (STRENGTH + self.parent_discount * np.maximum(self.parent_tables - (top - kept), 0)) / (self.words + 1)
        return (left - self.parent_discount * kept + fresh) / room

    def types_less(self, bucket: Bucket, below: np.ndarray, top: np.ndarray, of: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """The probability of types ``of`` of ``bucket`` in their context, each without ``gone`` of its customers."""
        left = bucket.customers[of] - gone
        kept = np.minimum(below[of], left)
        word, context = bucket.word[of], bucket.context[of]
        parent = self.parent_less(np.add.reduceat(below, bucket.first)[word], top[word], below[of] - kept)
        room = STRENGTH + np.maximum(self.customers[context] - gone, 0)
        fresh = (STRENGTH + self.discount * np.maximum(self.tables[context] - (below[of] - kept), 0)) * parent
        return (left - self.discount * kept + fresh) / room

    def back_off(self, context: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discount * self.tables[context]) / (STRENGTH + self.customers[context])

    def types(self, bucket: Bucket, below: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each type of ``bucket`` in its context, and the parent's of each word."""
        parent = self.parent(np.add.reduceat(below, bucket.first), top)
        return self.seen(bucket.context, bucket.customers, below) + self.back_off(bucket.context) * parent[bucket.word], parent

    def seen(self, context: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables) / (STRENGTH + self.customers[context])


@lru_cache(maxsize=8)
def log_arrangements(discount: float, most: int) -> np.ndarray:
    """(most + 1, most + 1) logs of how much the seatings of c customers at t tables weigh together (generalised Stirling numbers)."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(most):
        with np.errstate(divide="ignore"):
            stay = np.where(c > t * discount, np.log(np.maximum(c - t * discount, 0)) + table[c], -np.inf)
        table[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], table[c, :-1])))
    return table


EXACT = 48  #: customers up to which the number of tables is drawn from its exact distribution


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each type, drawn given everything else: a Gibbs step for all customers of a type at once.

    ``others``: tables of the other types of the restaurant; ``base``: the
    parent's probability without what this type has there.  t tables weigh the
    product of STRENGTH + discount * (others + k) over k < t, base ** t, and the
    weight of all seatings of the customers at t tables.  A type of more than
    EXACT customers seats them one after the other instead.
    """
    tables = np.ones(len(customers), np.int64)
    weight = log_arrangements(round(discount, 6), EXACT)
    log_base = np.log(np.maximum(base, 1e-300))
    order = np.argsort(customers, kind="stable")
    size = customers[order]
    for c in np.unique(size[(size > 1) & (size <= EXACT)]).tolist():
        at = order[slice(*np.searchsorted(size, (c, c + 1)))]
        for part in np.split(at, range(1 << 16, len(at), 1 << 16)):
            k = np.arange(c)
            chance = np.cumsum(np.log(STRENGTH + discount * (others[part][:, None] + k)) + log_base[part][:, None], axis=1) + weight[c, 1 : c + 1]
            tables[part] = np.argmax(chance + rng.gumbel(size=chance.shape), axis=1) + 1
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = _seat_one_by_one(customers[many], others[many], base[many], discount, rng)
    return tables


def _seat_one_by_one(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator, singly: int = 64) -> np.ndarray:
    """Tables after seating each type's customers by the Chinese restaurant process.

    The first ``singly`` customers of a type are seated singly.  From there on
    the wait until one opens a table is drawn at once: the chance of none among
    the next k is (1 + k / m) ** -a, with m the customers less discounts and a
    the weight of a new table.
    """
    t = np.ones(len(customers))
    for seated in range(1, singly):
        some = np.flatnonzero(customers > seated)
        fresh = (STRENGTH + discount * (others[some] + t[some])) * base[some]
        t[some] += rng.random(len(some)) * (fresh + seated - discount * t[some]) < fresh
    at = np.flatnonzero(customers > singly)
    seated = np.full(len(at), float(singly))
    while len(at):
        fresh = (STRENGTH + discount * (others[at] + t[at])) * base[at]
        left = np.maximum(seated - discount * t[at], 1e-3)
        with np.errstate(over="ignore"):
            wait = left * np.expm1(-np.log(1.0 - rng.random(len(at))) / np.maximum(fresh, 1e-12))
        seated = seated + np.floor(np.minimum(wait, 1e15)) + 1
        more = seated <= customers[at]
        at, seated = at[more], seated[more]
        t[at] += 1
    return t.astype(np.int64)


def _contexts(state: DataFrame, bits: int) -> DataFrame:
    """(bucket, part, contexts, customers, tables): what each context has over all words.

    ``part`` is the bucket of contexts.  Rows of bucket -1 hold the contexts of
    their part; the others answer a bucket of words, in the order of its contexts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = Pairs.of(row)
                seating = unpack(row["tables"], "<i8")
                size = len(pairs.keys) + len(pairs.first) + len(pairs.types.words)
                contexts, context = pairs.by_context
                sums = [np.bincount(context, x).astype(np.int64) for x in (pairs.customers, pairs.split(seating[-size:])[0])]
                parts = _buckets_of(contexts, bits)
                columns = [[pack_sorted(contexts[a:b]) for _, a, b in parts], *([pack(x[a:b]) for _, a, b in parts] for x in sums)]
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "part", "contexts", "customers", "tables"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(x) for x in group["contexts"]]
        contexts, where = np.unique(np.concatenate(asked), return_inverse=True)
        customers, tables = (np.bincount(where, np.concatenate([unpack(x, "<i8") for x in group[c]])).astype(np.int64) for c in ("customers", "tables"))
        part = int(group["part"].iloc[0])
        out = [(-1, part, pack_sorted(contexts), pack(customers), pack(tables))]
        ends = np.cumsum([len(x) for x in asked])
        for bucket, x, end in zip(group["bucket"], asked, ends):
            out.append((bucket, part, b"", b"", pack(tables[where[end - len(x) : end]])))
        return pd.DataFrame(out, columns=["bucket", "part", "contexts", "customers", "tables"])

    kinds = "bucket int, part int, contexts binary, customers binary, tables binary"
    return state.mapInArrow(send, kinds).groupBy("part").applyInPandas(add, kinds)


def _sweep(state: DataFrame, contexts: DataFrame, shared: Shared, number: int, seed: int) -> DataFrame:
    """The state after one Gibbs sweep; samples after the burn-in are appended to ``tables``."""

    def run(model: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = model.iloc[0]
        pairs, kept = Pairs.of(row), unpack(row["tables"], "<i8")
        size = len(pairs.keys) + len(pairs.first) + len(pairs.types.words)
        tables, below, top = pairs.split(kept[-size:])
        total = np.concatenate([unpack(x, "<i8") for x in told.sort_values("part")["tables"]])
        rng = np.random.default_rng([seed, number, int(row["bucket"])])
        # what a pair or type has in its parents goes with it before it is seated anew
        base = shared.types_less(pairs.above(tables), below, top, pairs.type, tables)
        tables = seat(pairs.customers, np.maximum(total[pairs.by_context[1]] - tables, 0), base, shared.pair_discount, rng)
        bucket = pairs.above(tables)
        base = shared.parent_less(np.add.reduceat(below, bucket.first)[bucket.word], top[bucket.word], below)
        below = seat(bucket.customers, np.maximum(shared.tables[bucket.context] - below, 0), base, shared.discount, rng)
        arrived = np.add.reduceat(below, bucket.first)
        top = seat(arrived, np.maximum(shared.parent_tables - top, 0), np.full(len(top), 1 / (shared.words + 1)), shared.parent_discount, rng)
        return pairs.row(int(row["bucket"]), kept if number > BURN_IN else kept[:0], (tables, below, top))

    told = contexts.where("bucket >= 0")
    return state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(run, _STATE)


def _total(state: DataFrame) -> Shared:
    sums = state.select(F.posexplode("shared").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # 523 rows
    total = np.zeros(523)
    for row in sums:
        total[row["k"]] = row["x"]
    return Shared(total)


def fit(docs: DataFrame, scratch: Scratch, seed: int = 8) -> tuple[DataFrame, DataFrame, list[Shared], int]:
    """(state of all buckets, contexts of each sample, shared numbers of each sample, bucket bits) of the model of ``docs``."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = min(20, max(0, (size // BUCKET_BYTES).bit_length()))
    state = scratch.keep(_counted(docs, bits), "pairs")
    contexts = scratch.keep(_contexts(state, bits), "contexts")
    shared = _total(state)
    samples, held = [], None
    for number in range(BURN_IN + SAMPLES):
        after = scratch.keep(_sweep(state, contexts, shared, number, seed), "seating")
        scratch.drop(state, *([contexts] if number <= BURN_IN else []))
        state = after
        contexts = scratch.keep(_contexts(state, bits), "contexts")
        shared = _total(state)
        if number >= BURN_IN:
            samples.append(shared)
            own = contexts.where("bucket < 0").withColumn("sample", F.lit(len(samples) - 1))
            held = own if held is None else held.unionByName(own)
    return state, held, samples, bits


_ANSWERS = "block long, kind int, bucket int, low binary, high binary, counts binary"


def _answers(docs: DataFrame, state: DataFrame, contexts: DataFrame, samples: list[Shared], bits: int, turn: int, rounds: int) -> DataFrame:
    """Answers to the pairs (kind 0) and contexts (kind 1) each block of texts of a round holds, of every sample one after the other.

    Of pairs: ``low`` the customers, then the tables, and of each of their types
    ``high`` the probability and ``counts`` the word's; of contexts: ``low`` the
    customers, ``high`` the tables.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _text_blocks(batches, BLOCK_CHARS):
            if _round_of(block, rounds) != turn:
                continue
            keys, before, _ = _unique_pairs(texts)
            distinct = np.unique(before)
            rows = [(0, k, pack_sorted(keys[a:b]), pack(before[a:b])) for k, a, b in _buckets_of(keys, bits)]
            rows += [(1, k, b"", pack_sorted(distinct[a:b])) for k, a, b in _buckets_of(distinct, bits)]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["block", "kind", "bucket", "keys", "before"])

    def answer(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(model):
            row = model.iloc[0]
            pairs = Pairs.of(row)
            seatings = [pairs.split(x) for x in unpack(row["tables"], "<i8").reshape(len(samples), -1)]
            buckets = [pairs.above(x) for x, _, _ in seatings]
            levels = [s.types(b, *x[1:]) for s, b, x in zip(samples, buckets, seatings)]
            types, words_ = buckets[0].keys, buckets[0].words
        for block, number, raw, raw_before in zip(asked["block"], asked["bucket"], asked["keys"], asked["before"]):
            keys, before = unpack_sorted(raw), unpack(raw_before, "<u8")
            of = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).astype(np.int64))))
            asked_types = keys[np.flatnonzero(np.diff(of, prepend=-1))]
            byte, word = (asked_types & U64(0xFF)).astype(np.int64), asked_types & ~U64(0xFF)
            low, high, count = np.zeros((1 + len(samples), len(keys)), "<u4"), np.zeros((len(samples), len(byte))), np.zeros(len(byte), np.int64)
            if len(model):
                at = np.minimum(np.searchsorted(words_, word), len(words_) - 1)
                known = words_[at] == word
                count[known] = pairs.counts[at[known]]
                place = np.minimum(np.searchsorted(types, asked_types), len(types) - 1)
                met = types[place] == asked_types
                own, seen = pairs.places(np.where(met, place, -1), of, before)
                low[0][seen] = pairs.customers[own[seen]]
            for k, s in enumerate(samples):
                parent = np.full(len(byte), s.unknown())
                if len(model):
                    parent[known] = levels[k][1][at[known]]
                high[k] = s.back_off(byte) * parent
                if len(model):
                    high[k][met] = levels[k][0][place[met]]
                    low[1 + k][seen] = seatings[k][0][own[seen]]
            out.append((block, 0, number, pack(low.ravel()), pack(high.ravel().astype("<f4")), pack(count)))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "low", "high", "counts"])

    def answer_contexts(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = [(unpack_sorted(r["keys"]), unpack(r["counts"], "<i8"), unpack(r["tables"], "<i8")) for _, r in model.sort_values("sample").iterrows()]
        for block, number, raw in zip(asked["block"], asked["bucket"], asked["before"]):
            wanted = unpack_sorted(raw)
            low, high = np.zeros((len(samples), len(wanted)), np.int64), np.zeros((len(samples), len(wanted)), np.int64)
            for k, (known, customers, tables) in enumerate(rows):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                seen = known[at] == wanted
                low[k][seen], high[k][seen] = customers[at[seen]], tables[at[seen]]
            out.append((block, 1, number, pack(low.ravel()), pack(high.ravel()), b""))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "low", "high", "counts"])

    def either(key: tuple, model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return (answer_contexts if key[0] else answer)(model, asked)

    asked = docs.mapInArrow(ask, "block long, kind int, bucket int, keys binary, before binary")
    pairs = state.select(F.lit(0).alias("kind"), "bucket", "keys", "before", "counts", "tables", F.lit(-1).alias("sample"))
    known = contexts.select(F.lit(1).alias("kind"), F.col("part").alias("bucket"), F.col("contexts").alias("keys"), F.lit(None).cast("binary").alias("before"), F.col("customers").alias("counts"), "tables", "sample")
    return pairs.unionByName(known).groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket")).applyInPandas(either, _ANSWERS)


def _bare_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns of files and nothing else, which reads alike each time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    return plan.nodeName().startswith("Relation") or "LogicalRelation" in plan.getClass().getName()


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_score``, ``score`` and ``perplexity``.

    A null or empty text is its end alone; a null doc_id is not held out;
    repeated rows are counted and scored as often as they stand; an empty
    table gives no rows, and if all rows are held out every word is unknown;
    other columns are not looked at.  ``docs`` must read alike each time (a
    table does); anything else is written to the shared folder first.
    """
    scratch = scratch or Scratch(docs.sparkSession, "hpyp")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _bare_scan(docs):
        docs = scratch.keep(docs, "documents")
    state, held, samples, bits = fit(docs, scratch)
    tokens, distinct = int(samples[-1].tokens), int(samples[-1].words)
    rounds = ROUNDS if bits else 1
    done = None
    for turn in range(rounds):
        answers = _answers(docs, state, held, samples, bits, turn, rounds)
        part = scratch.keep(_scores_of(docs, answers, samples, tokens, distinct, turn, rounds), "scores")
        done = part if done is None else done.unionByName(part)
    scratch.drop(state, held)
    return done.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _scores_of(docs: DataFrame, answers: DataFrame, samples: list[Shared], tokens: int, distinct: int, turn: int, rounds: int) -> DataFrame:
    """The scores of the blocks of a round, from the answers to them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _text_blocks(batches, BLOCK_CHARS):
            if _round_of(block, rounds) != turn:
                continue
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays([pa.array([block] * (b - a), pa.int64()), pa.array(range(a, b), pa.int32()), pa.array(ids[a:b], pa.int64()), pa.array(texts[a:b], pa.string())], names=["block", "row", "doc_id", "text"])

    def add_up(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        texts = rows["text"].tolist()
        found = found.sort_values("bucket")
        pairs, told = found[found["kind"] == 0], found[found["kind"] == 1]
        joined = lambda part, name, kind, n: np.concatenate([unpack(x, kind).reshape(n, -1) for x in part[name]], 1).astype(float)
        low, high = joined(pairs, "low", "<u4", 1 + len(samples)), joined(pairs, "high", "<f4", len(samples))
        counts = np.concatenate([unpack(x, "<i8") for x in pairs["counts"]])
        key, previous, offset = _whole(texts)
        order, start = _sorted_pairs(key, previous)
        keys, before = key[order[start]], previous[order[start]]
        which = np.empty(len(key), np.int64)  # pair of each token
        which[order] = np.repeat(np.arange(len(start)), np.diff(start, append=len(key)))
        contexts, context = np.unique(before, return_inverse=True)
        customers, tables = joined(told, "low", "<i8", len(samples)), joined(told, "high", "<i8", len(samples))
        of_type = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1]))) - 1
        if len(keys) != low.shape[1] or of_type[-1] + 1 != len(counts) or len(contexts) != customers.shape[1]:
            raise RuntimeError("the documents changed between two reads")
        chance = np.zeros(len(keys))
        for k, s in enumerate(samples):
            back_off = STRENGTH + s.pair_discount * tables[k]
            chance += (low[0] - s.pair_discount * low[1 + k] + back_off[context] * high[k][of_type]) / (STRENGTH + customers[k])[context] / len(samples)
        logs, counts = np.log10(chance), counts[of_type]
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
        sums = [np.add.reduceat(x[which], offset[:-1]) for x in (base, logs, (counts > 0).astype(np.int64))]
        table = pd.DataFrame({"n_tokens": np.diff(offset), "n_known": sums[2], "base_score": sums[0], "score": sums[1]})
        table.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
        table["held_out"] = [held_out(None if pd.isna(i) else int(i)) for i in table["doc_id"]]
        table["train_tokens"] = tokens
        return table[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    numbered = docs.mapInArrow(number, "block long, row int, doc_id long, text string")
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add_up, _SCORES)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
