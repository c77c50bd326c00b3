"""The places of asked pairs among those of a bucket."""

import numpy as np

from swarmlens.llm import hpyp


def test_pairs_are_numbered_once_for_all_that_ask(monkeypatch):
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(1, 40, 400).astype(np.uint64) << np.uint64(8))
    before = rng.integers(0, 1 << 20, 400).astype(np.uint64) << np.uint64(24)
    order, start = hpyp._sorted_pairs(key, before)
    pairs = hpyp.Pairs(key[order[start]], before[order[start]], np.ones(len(start), np.int64))
    composite, sizes = hpyp._composite, []
    monkeypatch.setattr(hpyp, "_composite", lambda rank, of: sizes.append(len(rank)) or composite(rank, of))
    for n in (3, 5, 8):
        ask = np.sort(rng.choice(len(pairs.keys), n, False))
        at, seen = pairs.places(np.arange(len(pairs.first)), pairs.type[ask], pairs.before[ask])
        assert seen.all() and (at == ask).all()
        assert not pairs.places(np.full(len(pairs.first), -1), pairs.type[ask], pairs.before[ask])[1].any()
    assert sizes.count(len(pairs.keys)) == 1
