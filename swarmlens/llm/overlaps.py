"""Common elements of every two of a bounded number of sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

FEW = 12  #: sets that hold an element, up to which their pairs are listed


def common_counts(sets: Sequence[np.ndarray]) -> np.ndarray:
    """(n, n) float32: how many elements two sets (of distinct elements each) have in common; 0 on the diagonal.

    An element that few sets hold adds its pairs one by one; the others come
    from products of incidence matrices, 1024 elements at a time.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    element = np.concatenate([np.asarray(x) for x in sets]) if n else np.zeros(0, np.int64)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    start = np.flatnonzero(np.concatenate((element[:1] == element[:1], element[1:] != element[:-1])))
    times = np.diff(start, append=len(element))
    shared = np.zeros((n, n), np.float32)
    pairs = [np.zeros(0, np.int64)]
    for t in range(2, FEW + 1):
        first = start[times == t]
        # owners come in order, so pairs are above the diagonal
        pairs += [owner[first + a] * n + owner[first + b] for a in range(t - 1) for b in range(a + 1, t) if len(first)]
    place, count = np.unique(np.concatenate(pairs), return_counts=True)
    shared.reshape(-1)[place] = count
    many = np.flatnonzero(times > FEW)
    for k in range(0, len(many), 1024):
        some = many[k : k + 1024]
        column = np.repeat(np.arange(len(some)), times[some])
        at = np.arange(len(column)) - np.repeat(np.cumsum(times[some]) - times[some], times[some]) + np.repeat(start[some], times[some])
        part = np.zeros((n, len(some)), np.float32)
        part[owner[at], column] = 1
        shared += np.triu(part @ part.T, 1)
    return shared + shared.T

