"""Fixed-size counting tables over 64-bit hashes, merged on the executors.

A table has ``2**bits`` counters whatever the input, so what reaches the
driver (one bit a counter) has a proven size and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 16


def _slices(bits: int) -> int:
    return max(1, (1 << bits) // SLICE)


def _merged(tables: DataFrame, merge: Callable, bits: int) -> np.ndarray:
    parts = _slices(bits)
    out = np.zeros((parts, (1 << bits) // parts), bool)
    marked = tables.groupBy("slice").applyInPandas(merge, "slice int, marked binary")
    for row in marked.collect():  # at most 2**bits / 65536 rows of 8 KB
        out[row["slice"]] = np.unpackbits(np.frombuffer(row["marked"], np.uint8)).astype(bool)
    return out.reshape(-1)


def counted_bits(
    df: DataFrame,
    hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    limit: Callable[[np.ndarray], float],
    bits: int = 20,
) -> np.ndarray:
    """Boolean array of ``2**bits``: whose counters exceed ``limit(counters of a slice)``.

    ``hashes`` yields, for a batch of ``df``, arrays of unsigned 64-bit hashes;
    the top ``bits`` bits of each name its counter.  Each task sends one
    saturating 16-bit table in slices; a slice's tables are added one by one.
    """
    shift = np.uint64(64 - bits)
    size, parts = 1 << bits, _slices(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.uint16), False
        for batch in batches:
            for h in hashes(batch):
                for k in range(0, len(h), SLICE):
                    place, times = np.unique((h[k : k + SLICE] >> shift).astype(np.int64), return_counts=True)
                    total[place] = np.minimum(total[place] + times, 65535)
                    seen = True
        if seen:
            table = total.astype("<u2").reshape(parts, -1)
            for k in range(parts):
                if table[k].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k].tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, where = None, None
        for table in tables:
            where = int(table["slice"].iloc[0])
            for raw in table["counts"]:
                part = np.frombuffer(raw, "<u2").astype(np.int64)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"slice": [where], "marked": [np.packbits(total > limit(total)).tobytes()]})

    return _merged(df.mapInArrow(count, "slice int, counts binary"), merge, bits)


MOST_BITS = 24


def marked_bits(df: DataFrame) -> np.ndarray | None:
    """Which of up to 2**24 places the 64-bit values of the one column of ``df``, a kept table, have; None if they'd fill them.

    The places are the top bits of the values, in packed bits: 32 to 64 a row
    where that is up to 2 MB, and four a row at least.  Beyond that such an
    array could hold back little and is left out.
    """
    n = df.count()
    if 4 * n > 1 << MOST_BITS:
        return None
    bits = min(MOST_BITS, max(16, (32 * n - 1).bit_length()))
    shift, parts = np.uint64(64 - bits), _slices(bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(hashed(batch.column(0)) >> shift)
            number = (place >> np.uint64(16)).astype(np.int64)
            cut = np.flatnonzero(np.diff(number)) + 1
            some = np.split((place & np.uint64(0xFFFF)).astype("<u2"), cut)
            slices = number[np.concatenate(([0], cut))] if len(place) else number
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([x.tobytes() for x in some][: len(slices)], pa.binary())], names=["slice", "counts"])

    def merge(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, where = np.zeros(SLICE, bool), None
        for table in tables:
            where = int(table["slice"].iloc[0])
            for raw in table["counts"]:
                total[np.frombuffer(raw, "<u2")] = True
        if where is not None:
            yield pd.DataFrame({"slice": [where], "marked": [np.packbits(total).tobytes()]})

    return np.packbits(_merged(df.mapInArrow(mark, "slice int, counts binary"), merge, bits))


def hashed(column: pa.Array) -> np.ndarray:
    """A column of longs as unsigned hashes; null is 0."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def among(marked: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Which of the hashes ``values`` may be among the marked ones."""
    if marked is None:
        return np.ones(len(values), bool)
    place = values >> np.uint64(64 - ((8 * len(marked)).bit_length() - 1))
    return (marked[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
