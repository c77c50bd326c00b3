"""Byte-level BPE encoding and decoding (2) by a monoid tree reduction.

Encodings of byte strings form a monoid: ``join`` takes the encodings of x and
y to the encoding of xy.  It re-encodes a window of tokens around the seam and
widens it, to the left and then token by token to the right, while an outer
neighbour could still change.  The stop is proven, not guessed: in a rank
vocabulary whose tokens encode to themselves, a token sequence is the encoding
of its bytes if and only if each neighbouring pair is the encoding of its own
bytes.  So once the window's ends form such pairs with their outer neighbours,
nothing outside can change.  A match of the
split pattern is encoded by halves, recursively, down to parts that are tokens
themselves; a text is the concatenation of its matches, which never merge.
Decoding concatenates the bytes of halves of the identifier list up a tree.

Each worker remembers the encodings of recent matches, parts and seams in
tables of a fixed number of entries; that changes speed only.  Long runs of one
character are linear but for a logarithm: merging keeps neighbours in a linked
list and candidates in a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

Tokens = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Recent(dict):
    """A table of bounded size: of two halves, the older is forgotten when the newer is full."""

    def __init__(self, most: int):
        self.half, self.old = most // 2, {}

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value


class MonoidBPE:
    """Encoder of byte strings for a table of ranks whose tokens encode to themselves."""

    PART = 8  #: bytes of the longest parts that are remembered

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.matches = regex.compile(pattern)
        self._seams, self._parts = _Recent(remembered), _Recent(remembered // 2)
        self._matches = _Matches(self, remembered)

    def merge(self, data: bytes) -> Tokens:
        """Rank merging: join the lowest-ranked neighbours, leftmost first."""
        return self._merge_short(data) if len(data) <= 64 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> Tokens:
        rank = self.ranks.get
        none = len(self.ranks)
        parts = [data[k : k + 1] for k in range(len(data))]
        order = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(order):
                order[at] = rank(parts[at] + parts[at + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, data: bytes) -> Tokens:
        """The same with a heap of (rank, place) and the places as a linked list."""
        rank, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # of the part that begins at a place; 0 if none does
        before = list(range(-1, n - 1))
        heap = []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < n:
                r = rank(data[at : end[end[at]]])
                if r is not None:
                    heap.append((r, at, end[end[at]])) if not ready else heapq.heappush(heap, (r, at, end[end[at]]))

        ready = False
        for at in range(n - 1):
            offer(at)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two was merged since
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
            offer(before[at])
            offer(at)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return tuple(out)

    def seam(self, a: int, b: int) -> Tokens | bool:
        """The encoding of the bytes of tokens a and b, side by side; True if it is just these two."""
        pair = (a, b)
        found = self._seams.get(pair) or self._seams.old.get(pair)
        if found is None:
            found = self.merge(self.bytes_of[a] + self.bytes_of[b])
            if found == pair:
                found = True
            self._seams.put(pair, found)
        return found

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The encoding of the bytes of ``left`` followed by those of ``right``, both being encodings."""
        if not left or not right:
            return left + right
        seam = self.seam
        found = seam(left[-1], right[0])
        if found is True:
            return left + right
        of, out = self.bytes_of, list(left)
        for k, token in enumerate(right):
            window, wider = (token,), 1
            while out:
                found = seam(out[-1], window[0])
                if found is True:
                    break
                if len(window) == 1:
                    out.pop()
                    window = found
                else:
                    some = out[-wider:]
                    del out[-wider:]
                    window = self.merge(b"".join([of[t] for t in some] + [of[t] for t in window]))
                    wider *= 2
            out.extend(window)
            if window[-1] == token:  # a whole token of ``right``, so what follows can't change
                return tuple(out) + right[k + 1 :]
        return tuple(out)

    def encode_piece(self, data: bytes) -> Tokens:
        """The encoding of one match of the split pattern, or of a part of one."""
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        short = len(data) <= self.PART
        if short:
            found = self._parts.get(data) or self._parts.old.get(data)
            if found is not None:
                return found
        half = len(data) // 2
        found = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
        if short:
            self._parts.put(data, found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Identifiers of ``text`` (uint32)."""
        if len(text) <= 1 << 20:
            return np.frombuffer(b"".join(map(self._matches.__getitem__, self.matches.findall(text))), "<u4")
        # the matches of a very long text are not all held at once
        parts, some = [], []
        for match in self.matches.finditer(text):
            some.append(self._matches[match.group()])
            if len(some) >= 1 << 16:
                parts.append(b"".join(some))
                some = []
        return np.frombuffer(b"".join([*parts, *some]), "<u4")

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ``ids``: concatenation of the bytes of both halves, down to short runs."""
        return self._decoded(np.asarray(ids, np.int64), 0, len(ids))

    def _decoded(self, ids: np.ndarray, start: int, end: int) -> bytes:
        if end - start <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids[start:end].tolist()))
        middle = (start + end) // 2
        return self._decoded(ids, start, middle) + self._decoded(ids, middle, end)


class _Matches(_Recent):
    """Encoded matches by text."""

    def __init__(self, bpe: MonoidBPE, most: int):
        super().__init__(most)
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        found = self.old.get(match)
        if found is None:
            tokens = self.bpe.encode_piece(match.encode())
            found = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(match) <= 64:
            self.put(match, found)
        return found


_encoders: dict[tuple[str, str], MonoidBPE] = {}


def encoder(path: str, pattern: str) -> MonoidBPE:
    """One encoder for each vocabulary and process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = MonoidBPE(read_ranks(path), pattern)
    return _encoders[path, pattern]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path of the rank file, split pattern) of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    values = np.concatenate([*ids, np.zeros(0, np.uint32)]).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text).

    A null text is an empty one, whose ids are an empty array; a null doc_id
    is kept; repeated rows give repeated rows; texts of any length are encoded
    whole; an empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = _id_lists([bpe.encode(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of every row of ``tokens`` (doc_id, ids); null or empty ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) per row of ``docs`` (doc_id, text).

    ``with_ids`` adds the identifiers themselves, ``ids`` array<int>.

    Identifiers are digested as little-endian unsigned 32-bit integers, then
    decoded again.  A null text is an empty one (no identifiers); repeated rows
    give repeated rows; texts of any length are encoded whole; an empty table
    gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns: list[list] = [[], [], [], []]
                held = []
                for value in part.column(1):
                    text = value.as_py() or ""
                    ids = bpe.encode(text)
                    back = bpe.decode(ids)
                    row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())
                    for column, x in zip(columns, row):
                        column.append(x)
                    if with_ids:
                        held.append(ids)
                arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_())))]
                yield pa.RecordBatch.from_arrays(arrays + ([_id_lists(held)] if with_ids else []), names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + (["ids"] if with_ids else [])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
