"""What the tasks of a Merkle manifest run: numbering of leaves, blocks, and supersteps up and down.

Workers import this module only, which keeps them small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

from pyspark import RDD

RUN, DEPTH = 3, 6
NODES_A_TASK = 4096  #: of a superstep, in the mean


def _parent(children: Iterable[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class _Summary(NamedTuple):
    """Of a partition of sorted leaves; a run is the leaves of one source in it."""

    partition: int
    runs: int
    first: tuple
    first_rows: int
    last: tuple
    last_rows: int
    longest: int


class _Start(NamedTuple):
    """Where a partition's leaves stand: the rank of its first source, and the leaves of its first and last one elsewhere."""

    rank: int
    before: int
    after: int


def summary(partition: int, rows: Iterator) -> Iterator[_Summary]:
    first = last = None
    runs = n = first_rows = longest = 0
    for row in rows:
        if last != (row[0],):
            if runs == 1:
                first_rows = n
            longest, n, runs, last = max(longest, n), 0, runs + 1, (row[0],)
            first = first or last
        n += 1
    if runs:
        yield _Summary(partition, runs, first, n if runs == 1 else first_rows, last, n, max(longest, n))


def scan(summaries: list[_Summary]) -> tuple[dict[int, _Start], int, int]:
    """Starts by partition, the number of sources and the leaves of the largest: one step a partition, forward and back."""
    starts, longest = {}, 0
    rank, known, run = -1, None, 0
    for s in summaries:
        before = run if s.first == known else 0
        rank += s.first != known
        starts[s.partition] = _Start(rank, before, 0)
        rank += s.runs - 1
        run, known = s.last_rows + (before if s.runs == 1 else 0), s.last
    ahead, known = 0, None
    for s in reversed(summaries):
        after = ahead if s.last == known else 0
        starts[s.partition] = starts[s.partition]._replace(after=after)
        ahead, known = s.first_rows + (after if s.runs == 1 else 0), s.first
        longest = max(longest, s.longest, ahead + starts[s.partition].before)
    return starts, rank + 1, longest


def chunks(starts: dict[int, _Start], size: int):
    """Sorted leaves as ((rank, block), (first, leaves, last)): what a partition has of a block, and whether its source ends there."""

    def run(partition: int, rows: Iterator) -> Iterator[tuple]:
        source, rank, i, held = None, 0, 0, []
        for row in rows:
            if source is None or source != (row[0],):
                if held:
                    yield (rank, (i - 1) // size), (i - len(held), held, True)
                rank, i = (starts[partition].rank, starts[partition].before) if source is None else (rank + 1, 0)
                source, held = (row[0],), []
            elif held and i % size == 0:
                yield (rank, (i - 1) // size), (i - len(held), held, False)
                held = []
            held.append(tuple(row)[1:])
            i += 1
        if held:
            yield (rank, (i - 1) // size), (i - len(held), held, starts[partition].after == 0)

    return run


def blocks_of(parts: Iterable) -> tuple[list, bool]:
    """(leaves, last) of a block from its chunks."""
    parts = sorted(parts)
    return [leaf for _, leaves, _ in parts for leaf in leaves], any(last for *_, last in parts)


def _levels(block: int, digests: list[str], depth: int) -> list[list[str]]:
    """The levels of a block's subtree, leaves first; only a source's first block may be less than ``depth`` high."""
    levels = [digests]
    while len(levels[-1]) > 1 or (block and len(levels) <= depth):
        below = levels[-1]
        levels.append([_parent(below[k : k + RUN]) for k in range(0, len(below), RUN)])
    return levels


def _steps(run: list[str], path: str) -> list[str]:
    """The path of each node of a run, given their parent's."""
    behind = "/" + path if path else ""
    return [",".join("*" if k == own else d for k, d in enumerate(run)) + behind for own in range(len(run))]


def _paths(levels: list[list[str]], path: str) -> list[str]:
    """The path of each leaf, given that of the block."""
    paths = [path]
    for below in reversed(levels[:-1]):
        paths = [p for k, above in enumerate(paths) for p in _steps(below[RUN * k : RUN * k + RUN], above)]
    return paths


def _family(messages: Iterable) -> tuple[list[str], bool]:
    """(digests of a parent's children, whether it is the last of its level)."""
    children = sorted(messages)
    last = any(x[2] for x in children)
    if [x[0] for x in children] != list(range(len(children))) or not (last or len(children) == RUN):
        raise ValueError("a parent lacks children")
    return [x[1] for x in children], last


def _is_root(node: tuple) -> bool:
    (_, place), (_, last) = node
    return place == 0 and last


class Forest:
    """Trees of blocks: ``blocks`` has ((tree, block), (leaves, last)), of which the first field of a leaf is its digest."""

    def __init__(self, blocks: RDD, leaves: int, longest: int, depth: int):
        self.blocks, self.tasks, self.depth = blocks, blocks.getNumPartitions(), depth
        nodes = blocks.map(lambda b: (b[0], (_levels(b[0][1], [leaf[0] for leaf in b[1][0]], depth)[-1][0], b[1][1])), True)
        self.families, roots, left = [], [], -(-longest // RUN**depth)
        while True:
            level = len(roots)
            roots.append(nodes.filter(_is_root).map(lambda x, level=level: (x[0][0], (x[1][0], level))))
            if left <= 1:
                break
            # only sources of more than a block * 3**level leaves go on
            tasks = min(self.tasks, 1 + leaves // (RUN ** (depth + level) * NODES_A_TASK))
            sent = nodes.filter(lambda x: not _is_root(x)).map(lambda x: ((x[0][0], x[0][1] // RUN), (x[0][1] % RUN, *x[1])))
            self.families.append(sent.groupByKey(tasks).mapValues(_family))
            nodes = self.families[-1].mapValues(lambda f: (_parent(f[0]), f[1]))
            left = -(-left // RUN)
        #: (tree, (root, superstep it was reached in))
        self.roots = blocks.context.union(roots)

    def leaves(self, known: RDD) -> RDD:
        """(leaf, path, more) of every leaf, given (tree, (superstep, path, more)) of the roots."""
        known = known.map(lambda x: ((x[0], 0), x[1]))
        paths = None
        for level in range(len(self.families), -1, -1):
            own = known.filter(lambda x, level=level: x[1][0] == level).mapValues(lambda v: v[1:])
            paths = own if paths is None else paths.union(own)
            if level:
                family = self.families[level - 1]
                paths = family.join(paths, family.getNumPartitions()).flatMap(_down)
        return self.blocks.join(paths, self.tasks).flatMap(_of_leaves(self.depth))


def _down(node: tuple) -> Iterator[tuple]:
    (tree, place), ((children, _), (path, more)) = node
    for k, step in enumerate(_steps(children, path)):
        yield (tree, place * RUN + k), (step, more)


def _of_leaves(depth: int):
    def run(block: tuple) -> Iterator[tuple]:
        (_, place), ((leaves, _), (path, more)) = block
        for leaf, own in zip(leaves, _paths(_levels(place, [x[0] for x in leaves], depth), path)):
            yield leaf, own, more

    return run
