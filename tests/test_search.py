"""The text and vector indexes and mentions against plain versions, and what they read."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmlens.operators import mentions
from swarmlens.plans import ranked, vectors


def bm25(docs, query, k):
    words = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    often = Counter(w for ws in words.values() for w in set(ws))
    asked = Counter(re.findall(r"[^\W_]+", query.lower()))
    scores = {}
    for d, ws in words.items():
        tf = Counter(ws)
        hits = [w * math.log(1 + (len(words) - often[t] + 0.5) / (often[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t, w in asked.items() if tf[t]]
        if hits:
            scores[d] = round(sum(hits), 6)
    best = sorted(scores, key=lambda d: (-scores[d], d))[:k]
    return [(n + 1, d, scores[d]) for n, d in enumerate(best)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(f"d{k:04d}", " ".join(rng.choices(vocab, weights, k=rng.choice([1, 2, 3, 5, 9, 40])))) for k in range(1500)]
    return docs + [("none", None), ("empty", ""), ("odd", "W1, w2! über-Maß 7")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    docs = spark.createDataFrame(corpus, "doc string, text string").repartition(3)
    return ranked.build(docs, f"file://{tmp_path_factory.mktemp('index')}", slab=40)


QUERIES = ["w0", "w59 w58 w59", "w0 w1 w2 w3", "W40, w1", "über maß 7", "nothing here"]


def test_search_is_that_of_scoring_all_documents(spark, index, corpus):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "q int, text string")
    found = {}
    for r in ranked.search_many(index, asked, 7).orderBy("q", "place").collect():
        found.setdefault(r["q"], []).append((r["place"], r["doc"], r["score"]))
    for q, text in enumerate(QUERIES):
        expected = bm25(corpus, text, 7)
        assert [x[:2] for x in found.get(q, [])] == [x[:2] for x in expected]
        assert [x[2] for x in found.get(q, [])] == pytest.approx([x[2] for x in expected], abs=2e-6)


def test_one_query_reads_the_postings_of_its_words_only(index):
    found = ranked.search(index, "w3 w50", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "postings" in x]
    assert scans and all("PartitionFilters: [" in x and "bucket" in x.split("PartitionFilters")[1] and "In(term" in x for x in scans)
    assert found.count() == 5


def test_bounds_rule_slabs_out(spark, index):
    """Of the slabs that hold a common word, few can reach the best ones."""
    held = index.table("bounds").where("term = 'w0'")
    least = ranked.search(index, "w0", 5).agg(F.min("score")).first()[0]
    n, _ = index.totals
    often = held.agg(F.sum("n")).first()[0]
    weight = math.log(1 + (n - often + 0.5) / (often + 0.5))
    assert held.where(F.col("top") * weight >= least).count() < held.count() / 2


def test_han_characters_are_terms(spark, tmp_path):
    docs = spark.createDataFrame([("a", "大学教授 said"), ("b", "学生 said")], "doc string, text string")
    found = ranked.search(ranked.build(docs, f"file://{tmp_path}"), "教授", 5)
    assert [r["doc"] for r in found.collect()] == ["a"]


def test_an_index_of_nothing(spark, tmp_path):
    index = ranked.build(spark.createDataFrame([("a", None)], "doc string, text string"), f"file://{tmp_path}")
    assert ranked.search(index, "word", 5).count() == 0


def test_fusion_of_ranks(spark):
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "q int, place int, doc string")
    two = spark.createDataFrame([(1, 1, "c"), (1, 2, "b")], "q int, place int, doc string")
    found = ranked.fused(one, two, k=2).orderBy("place").collect()
    assert [r["doc"] for r in found] == ["b", "a"] and found[0]["score"] == round(2 / 62, 9)


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(25, 24))
    rows = np.concatenate([c + 0.4 * rng.normal(size=(120, 24)) for c in centers])
    data = [(k, [float(x) for x in row]) for k, row in enumerate(rows)] + [(9000, None), (9001, [0.0] * 24)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4).cache()
    return rows.astype(np.float32).astype(np.float64), frame, vectors.build(frame, f"file://{tmp_path_factory.mktemp('vectors')}")


def nearest(rows, q, k):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    similar = np.round(unit @ unit[q], 9)
    similar[q] = -9
    return sorted(range(len(rows)), key=lambda i: (-similar[i], i))[:k]


def test_nearest_vectors(space):
    rows, frame, index = space
    asked = frame.where("vec_id % 100 = 0").selectExpr("vec_id AS q", "embedding")
    for settings, least in (({"exact": True}, 1.0), ({"probes": 8}, 0.9)):
        found = {}
        for r in vectors.nearest_many(index, frame, asked, 10, **settings).collect():
            found.setdefault(r["q"], []).append(r["vec_id"])
        queries = [q for q in range(0, len(rows), 100)]
        hits = [len(set(found[q]) & set(nearest(rows, q, 10))) for q in queries]
        assert sum(hits) >= least * 10 * len(queries)
        assert set(found) >= set(queries) and all(len(found[q]) == 10 for q in queries)


def test_every_vector_is_in_one_list(space):
    rows, _, index = space
    codes = index.table("codes")
    assert codes.count() == codes.select("vec_id").distinct().count() == len(rows) + 1
    assert len(index.centers()) == round((len(rows) + 1) ** 0.5)


def test_mentions(spark):
    rng = random.Random(1)
    letters = "abcAB é#0"
    names = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12])))) for k in range(150)] + [(900, None), (901, ""), (902, "abc"), (903, "ABC"), (904, "x" * 30)]
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 200])))) for k in range(80)] + [(500, None)]
    texts += [(600 + k, texts[5][1]) for k in range(3)] + [(700 + k, f"..{names[k][1]}..") for k in range(20)] + [(800, "y" * 100_000)]
    expected = {(i, j) for i, n in names for j, t in texts if n and t and n.lower() in t.lower()}
    a, b = spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(texts, "text_id int, text string")
    got = mentions.mentions(a, b)
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    counts = {r["name_id"]: r["n_texts"] for r in mentions.mention_counts(a, b).collect()}
    assert counts == {i: sum(x == i for x, _ in expected) for i, _ in names}
