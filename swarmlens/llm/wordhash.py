"""Vectorised word and shingle hashing over batches of texts.

Words are maximal runs of bytes outside space and 0x09-0x0D of the UTF-8 text,
which are the same words as ``[^\\x20\\x09-\\x0D]+`` on code points.  A batch
is hashed with a handful of numpy passes over its bytes; nothing loops over
words in Python.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); bijective."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(_BASE))


_BYTE = _stream(256, 11)
_STEP = _stream(64, 77) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNK = 1 << 18  #: bytes hashed at once; what that needs doesn't grow with a text


def _powers_of(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        steps = np.full(n, base, U64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out


_powers = _powers_of(CHUNK + 1)


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; only tables of fixed size are kept."""
    return _powers if n <= CHUNK + 1 else _powers_of(n)


class Words(NamedTuple):
    """Words of several texts: words ``offset[d]:offset[d + 1]`` are text d's."""

    hash: np.ndarray  # uint64
    start: np.ndarray  # first byte of each word in ``data``
    end: np.ndarray  # byte after its last
    offset: np.ndarray  # int64, number of texts + 1
    data: np.ndarray  # uint8, texts joined by a space
    first: np.ndarray  # int64, byte of ``data`` where each text starts, and the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def _pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial) of the words of a chunk; a word may go on in the next."""
    blank = _SPACE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.concatenate(([] if blank[0] else [0], edge, [] if blank[-1] else [len(data)])).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    power, inverse = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return start, end, (total[end] - total[start]) * inverse[start]


def words(texts: Sequence[str | None], lower: bool = True) -> Words:
    """Hash every word of ``texts``; ``lower`` maps A-Z to a-z first."""
    raw = [b"" if t is None else t.encode() for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=first[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    del raw
    if lower:
        data = _LOWER[data]
    starts, ends, codes = [], [], []
    for at in range(0, len(data), CHUNK):
        start, end, code = _pieces(data[at : at + CHUNK])
        start, end = start + at, end + at
        if len(start) and ends and len(ends[-1]) and start[0] == at == ends[-1][-1]:  # a word across the edge
            done = int(at - starts[-1][-1])
            codes[-1][-1] = U64((int(codes[-1][-1]) + int(code[0]) * pow(_BASE, done, 1 << 64)) % (1 << 64))
            ends[-1][-1] = end[0]
            start, end, code = start[1:], end[1:], code[1:]
            if not len(start):
                continue
        starts.append(start)
        ends.append(end)
        codes.append(code)
    start, end = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, ends))
    code = mix(np.concatenate([*codes, np.zeros(0, U64)]))
    return Words(code, start, end, np.searchsorted(start, first), data, first)


def blocks(texts: Sequence[str | None], block_bytes: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``block_bytes`` each; a longer text is a slice of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > block_bytes:
            yield first, k
            first, size = k, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring words, ignoring text ends."""
    n = max(0, len(code) - width + 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out += code[k : k + n] * _STEP[k]
    return mix(out)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offset) of the shingles of each text, in order and with repeats.

    A text of fewer than ``width`` words has its whole sequence as one shingle,
    a text without words has none.
    """
    n = np.diff(w.offset)
    count = np.where(n >= width, n - width + 1, n > 0)
    offset = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=offset[1:])
    code = windows(w.hash, width)
    out = np.zeros(offset[-1], U64)
    full = n >= width
    if full.any():
        # the window that starts at word i is valid if i + width does not pass the text's end
        where = np.arange(len(code))
        doc = w.doc[: len(code)]
        valid = where + width <= w.offset[doc + 1]
        target = np.flatnonzero(np.repeat(full, count))
        out[target] = code[valid]
    for d in np.flatnonzero(~full & (n > 0)):
        part = w.hash[w.offset[d] : w.offset[d + 1]]
        value = U64(0)
        for k, h in enumerate(part):
            value = U64((int(value) + int(h) * int(_STEP[k])) & ((1 << 64) - 1))
        out[offset[d]] = mix(np.array([int(value) ^ (0x5BD1E995 * (len(part) + 1))], U64))[0]
    return out, offset
