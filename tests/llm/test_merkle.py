"""The Merkle manifest against a plain version, with blocks and runs cut everywhere."""

import random
import zlib
from hashlib import sha256

import pytest
from helpers import SCHEMA, table
from pyspark.sql import functions as F

from swarmlens.llm import merkle


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    parts = []
    for v in row:
        raw = None if v is None else str(v).encode()
        parts.append("-" if raw is None else f"{len(raw)}:{raw.decode()}")
    return digest(*parts)


def tree(digests):
    """(root, the siblings of each leaf level by level as (place, run))."""
    level, at, proofs = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for k in range(len(digests)):
            p = at[k] // 3
            proofs[k].append((at[k] % 3, level[3 * p : 3 * p + 3]))
            at[k] = p
        level = [digest(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], proofs


def expected(rows, tamper):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    placed = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in groups[s]) for s in order}
    trees = {s: tree([k[2] for k, _ in placed[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, r), own in zip(placed[s], trees[s][1]):
            found = r
            if tamper(r) and r[4] is not None:
                found = (*r[:4], r[4].replace("\n", ""))
            d = leaf(found)
            for place, run in own + top:
                d = digest(*run[:place], d, *run[place + 1 :])
            siblings = [x for place, run in own + top for k, x in enumerate(run) if k != place]
            out.append((r[0], leaf(r), trees[s][0], root, digest(*siblings), d, d == root))
    return out


def is_chosen(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0


def check(spark, rows, **settings):
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    data = [(r[4], r[0], r[2], r[1], r[3], 1, 2, 3) for r in rows]
    got = merkle.verified(spark.createDataFrame(data, SCHEMA).repartition(3), now, **settings).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, is_chosen), key=key)
    return got


def some_rows(counts, seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, count in counts.items():
        for _ in range(count):
            text = rng.choice(["", None, "é\n1", "a\nb", "word " * rng.randint(0, 9), f"x{n}"])
            rows.append((n if rng.random() < 0.9 else rng.randrange(50), source, rng.choice(["en", None]), None if text is None else len(text), text))
            n += 1
    rng.shuffle(rows)
    return rows


def test_manifest(spark):
    rows = some_rows({None: 7, "": 1, "s1": 30, "Z": 2, "é": 3, "s10": 4, "big": 900})
    rows += [(None, "s1", None, None, None), (None, "s1", None, None, None), (3, "s1", "en", 1, "x"), (3, "s1", "en", 1, "x"), (9, "s1", "en", None, "line\n" * 300_000)]
    got = check(spark, rows)
    assert {r["verified"] for r in got} == {True, False}
    assert len({r["root"] for r in got}) == 1


@pytest.mark.parametrize("depth", [1, 2])
def test_many_supersteps(spark, depth):
    """Blocks of 3 and of 9 leaves, so that most levels are supersteps, of either tree."""
    check(spark, some_rows({"hot": 200, **{f"s{k}": 1 + k % 11 for k in range(30)}}, seed=depth), depth=depth)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 2}, {"a": 1, "b": 1}, {"a": 729}, {"a": 730}, {"a": 2188}, {"a": 3, None: 1, "c": 10}])
def test_few_leaves_and_full_blocks(spark, counts):
    check(spark, some_rows(counts))


def test_no_rows(spark):
    assert merkle.verified(table(spark, [])).count() == 0


def test_unchanged_rows_are_verified_and_others_are_not(spark):
    docs = table(spark, [(k, f"text {k}") for k in range(40)])
    assert merkle.verified(docs).where("verified").count() == 40
    assert merkle.verified(docs, F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))).where("not verified").collect()[0]["doc_id"] == 7
