"""The pipeline, each stage against a plain version of it on the stage's own input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import lower, words
from test_operators import base_counts, dropped, linked_classes, tiling

import corpus_pipeline
from swarmlens.llm import bpe, quality_crf

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, region long, gone string, lines int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "g", 3) for i, t in rows], COLUMNS)


def texts():
    rng = random.Random(31)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."
    rows = [(k, "\n".join(prose(rng.randint(8, 30)) for _ in range(6))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(110 + k, rows[20 + k][1].replace("w1", "w2", 1) + " tail") for k in range(5)]  # near copies
    rows += [(120 + k, "\n".join(["BUY NOW!! $$$ ### CLICK"] * 20)) for k in range(5)]
    rows += [(130, rows[7][1].split("\n")[2] + "\n" + "\n".join(prose(25) for _ in range(4)))]  # a line of another
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "short"), (None, rows[3][1]), (None, None), (rows[4][0], rows[4][1])]
    return rows


ITEM = " ".join(f"q{k}" for k in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = texts() + [(300, "\n".join([texts()[9][1].replace("w", "v"), ITEM[:60], ITEM[60:]]))]
    table(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(0, 60, 2), *range(120, 125)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def found(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = found(docs)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    crf = quality_crf.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = set()
    for i, t in before:
        n, *_, again = base_counts(t)
        lines = quality_crf.Lines([t])
        label = crf.viterbi(crf.scores(lines.features))
        share = sum(int(w) for w, y in zip(lines.words, label) if y == 0) / max(1, n)
        if n >= 50 and 100 * again <= 50 * n and share >= 0.5:
            good.add((i, t))
    bad_ids = {i for i, t in before if (i, t) not in good}
    assert found(kept) == Counter({x: n for x, n in before.items() if x[0] not in bad_ids})
    assert not {120, 200, 201, 202, 203, None} & {i for i, _ in found(kept)}

    lines = stages["line dedup"](spark, kept, folder)
    rows = found(kept)
    gone = dropped(list(rows))
    expected = Counter()
    for (i, t), n in rows.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if words(left):
            expected[i, left] += n
    assert found(lines) == expected and lines.columns == docs.columns

    near = stages["n-gram Jaccard join"](spark, lines, folder)
    classes = linked_classes(list(expected))
    assert found(near) == Counter({x: n for x, n in expected.items() if classes[x[0]][1] == x[0]})

    clean = stages["benchmark decontamination"](spark, near, folder)
    item = np.array([hash(w) & (1 << 63) - 1 for w in words(ITEM)], np.uint64)
    hit = {i for i, t in found(near) if sum(n for *_, n in tiling.tiles(np.array([hash(w) & (1 << 63) - 1 for w in words(lower(t))], np.uint64), item, 5)) >= 15}
    assert found(clean) == Counter({x: n for x, n in found(near).items() if x[0] not in hit}) and 300 in hit

    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    tokens = stages["byte-level BPE"](spark, clean, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens) == Counter({(i, tuple(library.encode_ordinary(t))): n for (i, t), n in found(clean).items()})
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in tokens)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole) == Counter((r["doc_id"], r["ids_sha256"]) for r in tokens)


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
