"""The MinHash join against all pairs, its recall, large groups of copies and its edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, lower, table, words

from swarmlens.llm import minhash_join as mj


def shingle_set(text):
    w = words(lower(text or ""))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def classes(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(frame, **settings):
    rows = mj.near_duplicates(frame, **settings).collect()
    return len(rows), {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def family(rng, size, n_words, edits, vocab=500):
    base = [f"w{rng.randrange(vocab)}" for _ in range(n_words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("settings", [{}, {"cell": 2, "block": 2, "levels": 3}])
def test_all_links_are_found(spark, settings):
    rng = random.Random(3)
    rows = corpus(seed=6) + [(2000 + k, t) for k, t in enumerate(family(rng, 40, 120, 7) + family(rng, 12, 30, 2) + ["a b", "A  b", "a", "b a"])]
    n, found = got(table(spark, rows).repartition(3), **settings)
    assert n == len(rows) and found == classes(rows)


def test_copies_of_a_passage_and_others_that_share_it(spark):
    """A passage that all texts hold and groups that are alike but for it: lists are long, links few."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randint(3, 60))) + " " + passage) for k in range(300)]
    n, found = got(table(spark, rows), cell=16, block=8, levels=3)
    assert n == 300 and found == classes(rows)


def test_a_large_group_and_its_neighbours(spark):
    rng = random.Random(4)
    texts = family(rng, 500, 100, 3) + [t + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) for t in family(rng, 30, 100, 1)]
    rows = list(enumerate(texts))
    assert got(table(spark, rows), cell=32, block=64)[1] == classes(rows)


def test_agreement_follows_the_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.85):
        rates = []
        for _ in range(200):
            n = 100
            both = round(2 * n * similarity / (1 + similarity))
            a = np.sort(rng.integers(0, 1 << 63, n, np.uint64))
            b = np.sort(np.concatenate((rng.choice(a, both, False), rng.integers(0, 1 << 63, n - both, np.uint64))))
            s = mj.signatures(np.concatenate((a, b)), np.array([0, n, 2 * n]))
            rates.append((s[0] == s[1]).mean())
        assert abs(np.mean(rates) - both / (2 * n - both)) < 0.02
        assert similarity < 0.8 or min(rates) * mj.COORDINATES >= mj.MATCHES


def test_one_of_each_stays(spark):
    rows = corpus(seed=7)
    frame = table(spark, rows)
    kept = mj.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    found = classes(rows)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if found[i][2])


def test_no_rows(spark):
    assert mj.near_duplicates(table(spark, [])).count() == 0


def test_null_ids_and_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"v{k}" for k in range(300_000))
    rows = [(None, text), (4, text), (None, None), (5, ""), (6, " \n"), (11, long), (12, long + " tail"), (13, "x" * 2_000_000)]
    found = mj.near_duplicates(table(spark, rows)).collect()
    expected = [(0, 0, 0, True), (0, 18, 4, False), (4, 18, 4, True), (5, 0, 5, True), (6, 0, 6, True), (11, 299_998, 11, True), (12, 299_999, 11, False), (13, 1, 13, True)]
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in found) == expected
