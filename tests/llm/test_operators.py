"""The operators against brute force over a small corpus, and their edge cases."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, lower, table, words

from swarmlens.llm import bpe, chat_format, hpyp, jaccard_join, langid, line_dedup, quality_crf, substring_dedup, tiling, token_counts, wordhash
from swarmlens.llm.components import connected
from swarmlens.llm.scratch import Scratch

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_word_hashes_are_those_of_the_words():
    texts = [t for _, t in ROWS]
    w = wordhash.words(texts)
    seen = {}
    for k, t in enumerate(texts):
        expected = words(lower(t or ""))
        got = w.hash[w.offset[k] : w.offset[k + 1]].tolist()
        assert len(got) == len(expected)
        for a, b in zip(expected, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def shingle_set(text):
    w = words(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots(ids, links).items()}


@pytest.mark.parametrize("settings", [{}, {"block": 2, "pivots": 1}])
def test_jaccard_join(docs, settings):
    rows = jaccard_join.jaccard_classes(docs, **settings).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == linked_classes(ROWS)


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(500)}"
        rows.append((k, " ".join(own)))
    got = jaccard_join.jaccard_classes(table(spark, rows), block=8, pivots=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == linked_classes(rows)


def test_one_of_each_keeps_the_least(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = Counter(i for i, _ in ROWS if linked_classes(ROWS)[i][1] == i)
    assert Counter(r["doc_id"] for r in kept.collect()) == expected


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(5, 5)]
    expected = roots({x for e in links for x in e if e[0] != e[1]}, links)
    got = connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["root"] for r in got.collect()} == {n: r for n, r in expected.items()}
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_byte_bpe(docs):
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = Counter()
    for i, t in ROWS:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        expected[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in bpe.digests(docs, path, pattern).collect()) == expected


def test_bpe_tables_round_trip(docs):
    path, pattern = bpe.vocabulary()
    back = bpe.decoded(bpe.encoded(docs, path, pattern), path, pattern).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == Counter((i, t or "") for i, t in ROWS)


def test_bpe_join_is_the_encoding_of_the_whole():
    path, pattern = bpe.vocabulary()
    own = bpe.encoder(path, pattern)
    rng = random.Random(2)
    for _ in range(300):
        x, y = ("".join(rng.choice("abeginorst ÄÖé日") for _ in range(rng.randint(0, 14))).encode() for _ in range(2))
        assert own.join(own.merge(x), own.merge(y)) == own.merge(x + y)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def dropped(rows):
    first, gone = {}, set()
    for i, t in sorted(set((i, t) for i, t in rows), key=lambda r: r[0]):
        for k, text in enumerate((t or "").split("\n")):
            w = tuple(words(lower(text)))
            if w:
                if w in first:
                    gone.add((i, k))
                else:
                    first[w] = (i, k)
    many = {w: p for w, p in first.items() if len(w) >= line_dedup.MIN_WORDS}
    groups = {}
    for w, p in many.items():
        for k in range(len(w)):
            groups.setdefault((w[:k] + w[k + 1 :], k), []).append(p)
    stays = set()
    for w, p in sorted(many.items(), key=lambda x: x[1]):
        # the first of each group that it is in, lines that lack one word of it, and that it lacks one word of
        partners = {min(groups[w[:k] + w[k + 1 :], k]) for k in range(len(w))} | {many.get(w[:k] + w[k + 1 :]) for k in range(len(w))}
        partners |= {min(groups[w, k]) for k in range(len(w) + 1) if (w, k) in groups}
        assert all(one_edit(next(v for v, q in many.items() if q == x), w) for x in partners - {None, p})
        if not partners & stays:
            stays.add(p)
    return gone | (set(many.values()) - stays)


def test_line_dedup(docs):
    rows = line_dedup.line_report(docs).collect()
    assert len(rows) == len({i for i, _ in ROWS})
    assert {(r["doc_id"], k) for r in rows for k in r["dropped"]} == dropped(ROWS)
    assert all(r["n_dropped"] == len(r["dropped"]) <= r["n_lines"] for r in rows)


def test_lines_leave_the_texts(docs):
    gone, kept = dropped(ROWS), line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    expected = Counter()
    for i, t in ROWS:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if not words(t) or words(left):
            expected[i, left, None if left is None else len(left)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()) == expected


def test_rows_that_repeat_a_doc_id_keep_their_own_lines(spark):
    again, unique = "dup line with quite a few words in it", "a completely different unique sentence of some length"
    rows = [(0, again), (5, again), (5, unique + "\n" + again), (5, unique + " more"), (5, unique + " more"), (None, again.upper()), (None, "x\n" + unique)]
    frame = table(spark, rows)
    left = Counter((r["doc_id"], r["text"]) for r in line_dedup.without_repeated_lines(frame).collect())
    said = Counter(w for (_, t), n in left.items() for w in t.lower().split("\n") for _ in range(n))
    assert said[again] == 1 and said["x"] == 1 and said[unique] + said[unique + " more"] >= 1
    assert not any(i in (0, 5) and again in t for i, t in left)  # the null doc_id is before all others
    assert sum(r["n_dropped"] for r in line_dedup.line_report(frame).collect()) == 5


def test_a_chain_of_lines_keeps_every_second(spark):
    base = [f"word{k}" for k in range(8)]
    lines = [" ".join(f"other{j}" if j < k else w for j, w in enumerate(base)) for k in range(5)]
    report = line_dedup.line_report(table(spark, list(enumerate(lines)))).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in report} == {k: k % 2 for k in range(5)}


def test_decontamination(spark):
    items = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"b{k}" for k in range(12))), (3, None), (4, "too short"), (5, "")]
    a = items[0][1].split()
    rows = [
        (1, "x y " + items[0][1].upper() + " z"),
        (2, " ".join(a[20:30] + ["gap"] + a[:10] + ["gap"] + a[10:20])),  # reordered
        (3, " ".join(a[:10])),
        (4, "nothing here at all to see"),
        (5, None),
        (6, ""),
        (7, "q " * 500 + items[1][1]),
        (7, "q " * 500 + items[1][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = tiling.contaminated(table(spark, rows), bench).collect()
    assert Counter((r["doc_id"], r["item_id"], r["tiles"], r["coverage"]) for r in got) == Counter({(1, 1, 1, 1.0): 1, (2, 1, 3, 1.0): 1, (7, 2, 1, 1.0): 2})
    clean = tiling.clean_documents(table(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]
    assert tiling.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_long_texts_of_one_word_are_quick():
    """A megabyte of one word, or of one character, takes no time that grows with its square."""
    began = time.time()
    item = np.full(400, 7, np.uint64)
    assert sum(n for *_, n in tiling.tiles(np.full(250_000, 7, np.uint64), item, 5)) == 400
    long = np.concatenate([np.full(100_000, 7, np.uint64), np.arange(100_000, dtype=np.uint64) + np.uint64(10)])
    assert tiling.tiles(long, np.concatenate([item, np.arange(50, dtype=np.uint64)]), 5)
    path, pattern = bpe.vocabulary()
    own = bpe.encoder(path, pattern)
    for text in ("=" * 1_000_000, "a" * 300_000, "a " * 500_000):
        assert own.decode(own.encode(text)).decode() == text
    assert time.time() - began < 100
    assert len(line_dedup.LineWords(["a " * 500_000 + "\n" + "b" * 3_000_000]).size) == 2


def test_bpe_of_long_runs_is_that_of_the_library():
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own, rng = bpe.encoder(path, pattern), random.Random(7)
    texts = ["=" * n for n in (63, 64, 65, 66, 129, 1001)] + ["a" * n for n in (65, 127, 500)] + ["".join(rng.choice("ab") for _ in range(700)) for _ in range(20)] + ["".join(rng.choice("=-#") for _ in range(300)) for _ in range(20)]
    for t in texts:
        assert own.encode(t).tolist() == library.encode_ordinary(t)


def test_short_items_have_to_occur_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four five six")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma y"), (2, "alpha beta x gamma"), (3, "ALPHA beta gamma"), (4, "one two three four")]
    got = {(r["doc_id"], r["item_id"], r["tiles"]) for r in tiling.contaminated(table(spark, rows), bench).collect()}
    assert got == {(1, 1, 1), (3, 1, 1)}


def test_a_seed_of_many_items_finds_few_candidates():
    texts = ["what is the right answer to " + " ".join(f"x{k}y{j}" for j in range(34)) for k in range(300)]
    items = tiling._Items(list(range(300)), texts, 5, 0.5)
    found = items.candidates(wordhash.words(["what is the right answer to everything " * 3, texts[7]]))
    assert [k for d, k in found if d == 0] == [] and [k for d, k in found if d == 1] == [7]


def test_tiles_are_the_greedy_ones():
    rng = random.Random(4)
    for _ in range(200):
        doc, item = (np.array([rng.randrange(5) for _ in range(rng.randint(0, 25))], np.uint64) for _ in range(2))
        free_a, free_b, expected = [True] * len(doc), [True] * len(item), 0
        while True:
            best = []
            for x in range(len(doc)):
                for y in range(len(item)):
                    n = 0
                    while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and free_a[x + n] and free_b[y + n]:
                        n += 1
                    if n >= 2 and (not best or n > best[0][2]):
                        best = [(x, y, n)]
                    elif best and n == best[0][2]:
                        best.append((x, y, n))
            if not best:
                break
            for x, y, n in best:
                if all(free_a[x : x + n]) and all(free_b[y : y + n]):
                    free_a[x : x + n], free_b[y : y + n] = [False] * n, [False] * n
                    expected += n
        assert sum(n for *_, n in tiling.tiles(doc, item, 2)) == expected


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    three = Counter(zip(w, w[1:], w[2:]))
    marked = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if three[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in ROWS], "doc_id long, quality int, toxic int")
    rows = quality_crf.judged(docs, quality_crf.fit(docs, labels)).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((i, *base_counts(t)) for i, t in ROWS)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["content_share"] >= 0.5)


def test_viterbi_and_fit_find_the_best_labels():
    rng = np.random.default_rng(1)
    crf = quality_crf.ChainCRF(rng.normal(size=(quality_crf.GROUPS, quality_crf.BUCKETS, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        score = crf.scores(rng.integers(0, 4, (n, quality_crf.GROUPS)).astype(np.uint8))
        every = [[x >> k & 1 for k in range(n)] for x in range(1 << n)]
        value = lambda y: sum(score[k, y[k]] for k in range(n)) + sum(crf.transition[a, b] for a, b in zip(y, y[1:]))
        assert value(crf.viterbi(score)) == pytest.approx(max(map(value, every)))
    good, bad = np.zeros((6, quality_crf.GROUPS), np.uint8), np.full((4, quality_crf.GROUPS), 3, np.uint8)
    fitted = quality_crf.ChainCRF().fit([good, bad] * 10, [np.zeros(6), np.ones(4)] * 10)
    assert fitted.viterbi(fitted.scores(good)) == [0] * 6 and fitted.viterbi(fitted.scores(bad)) == [1] * 4


def test_gradient_is_that_of_the_enumerated_likelihood():
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 3, (n, quality_crf.GROUPS)).astype(np.uint8) for n in (4, 1, 3)]
    labels = [rng.integers(0, 2, len(x)) for x in sequences]
    crf = quality_crf.ChainCRF(rng.normal(size=(quality_crf.GROUPS, quality_crf.BUCKETS, 2)), rng.normal(size=(2, 2)))

    def likelihood():
        total = 0.0
        for x, y in zip(sequences, labels):
            score = crf.scores(x)
            value = lambda z: sum(score[k, z[k]] for k in range(len(z))) + sum(crf.transition[a, b] for a, b in zip(z, z[1:]))
            total += value(y) - np.logaddexp.reduce([value([n >> k & 1 for k in range(len(x))]) for n in range(1 << len(x))])
        return total

    order, flat, rows, alive = quality_crf._laid_out(sequences)
    gain, turn = crf.gradient(flat, np.concatenate([labels[k] for k in order]), rows, alive)
    for table, slope in ((crf.emission, gain), (crf.transition, turn)):
        for at in [tuple(rng.integers(0, n) for n in table.shape) for _ in range(12)]:
            table[at] += 1e-5
            up = likelihood()
            table[at] -= 2e-5
            assert slope[at] == pytest.approx((up - likelihood()) / 2e-5, abs=1e-4)
            table[at] += 1e-5


def test_lines_of_mixed_documents_get_labels_of_their_own(spark):
    """Documents that are part boilerplate: labelled as wholes, told apart by line."""
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(15, 30))) + "."
    junk = lambda: " ".join(rng.choice(["BUY", "CLICK", "NOW!!", "$$$", "###", "100%"]) for _ in range(rng.randint(4, 9)))
    rows = [(k, "\n".join((prose if rng.random() < (0.8 if k % 2 else 0.2) else junk)() for _ in range(12))) for k in range(160)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    crf = quality_crf.fit(table(spark, rows), labels)
    mixed = [(1000 + k, "\n".join([prose() for _ in range(4)] + [junk() for _ in range(4)])) for k in range(20)]
    got = quality_crf.judged(table(spark, mixed), crf).collect()
    assert all(0 < r["content_share"] < 1 for r in got)
    lines = quality_crf.Lines([t for _, t in mixed])
    for k in range(20):
        found = crf.viterbi(crf.scores(lines.features[lines.offset[k] : lines.offset[k + 1]]))
        assert sum(a == b for a, b in zip(found, [0] * 4 + [1] * 4)) >= 7


def trigrams_of(text):
    folded = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in (" " + text + " ").encode().lower() if True)
    out = [folded[0]]
    for c in folded[1:]:
        if c != " " or out[-1] != " ":
            out.append(c)
    return ["".join(out[k : k + 3]) for k in range(len(out) - 2)]


def test_language_id_is_loss_weighted_decoding(spark):
    """Predictions and scores again, trigram by trigram."""
    rng = random.Random(16)
    parts = {"aa": "ba be bi bo", "bb": "be ti to na", "cc": "na ne bo tu"}
    rows = [(k, " ".join("".join(rng.choice(p.split()) for _ in range(3)) for _ in range(12)), g) for k, (g, p) in enumerate(list(parts.items()) * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {g: Counter() for g in parts}
    for i, t, g in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            counts[g].update(trigrams_of(t))
    bucket = {x: int(langid.trigrams([x[1] if x[0] == x[2] == " " else x.strip()])[0][0]) for c in counts.values() for x in c if len(x.strip()) > 0}
    assert len(bucket) > 20
    names, codes = sorted(parts), langid.codewords(3)
    share = {g: {x: n / counts[g].total() for x, n in counts[g].items()} for g in names}

    def odds(x, b):
        side = lambda v: np.mean([share[g].get(x, 0) for k, g in enumerate(names) if codes[k, b] == v])
        return math.log((side(1) + 1e-7) / (side(0) + 1e-7))

    weight = [max(0.05, min((2 * codes[k, b] - 1) * sum(p * odds(x, b) for x, p in share[g].items()) for k, g in enumerate(names))) for b in range(codes.shape[1])]
    weight = [w / sum(weight) for w in weight]
    got = {r["doc_id"]: r for r in langid.identified(frame, langid.fit(frame)).collect()}
    for i, t, _ in rows:
        seen = trigrams_of(t)
        margin = [langid.SHARPNESS * np.mean([odds(x, b) for x in seen]) for b in range(codes.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-(2 * codes[k, b] - 1) * margin[b])) for b, w in enumerate(weight)) * len(weight) for k in range(3)]
        chance = [math.exp(min(loss) - x) for x in loss]
        best = max(range(3), key=lambda k: chance[k])
        assert got[i]["lang_pred"] == names[best] and got[i]["score"] == pytest.approx(chance[best] / sum(chance), abs=1e-3)


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ei", "ung", "ver"], "zz": ["eau", "oi", "ç", "qu"]}
    rows = [(k, " ".join("".join(rng.choice(parts[g]) for _ in range(3)) for _ in range(20)), g) for k, g in enumerate(["xx", "yy", "zz"] * 30)]
    rows += [(500, None, "xx"), (501, "123 !!", "yy"), (502, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identified(frame, langid.fit(frame)).collect()}
    assert all(got[k]["lang_pred"] == g for k, _, g in rows[:90])
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values())
    nothing = langid.fit(frame.limit(0))
    assert {r["lang_pred"] for r in langid.identified(frame, nothing).collect()} == {"und"}


def test_all_of_300_languages_are_learned(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)] for k in range(300)}
    rows = [(n, " ".join(rng.choice(parts[g]) for _ in range(30)), g) for n, g in enumerate(g for g in parts for _ in range(4))]
    rows += [(9000, None, "only null"), (9001, "", "only empty")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert set(model.languages) == {g for i, t, g in rows if t and not langid.held_out(i)}
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identified(frame, model).collect()}
    assert sum(found[i] == g for i, t, g in rows if t) >= 0.98 * 1200


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 2000):
        table = langid.codewords(n)
        if n > langid.COMPARED:
            assert len({r.tobytes() for r in table}) == n
            continue
        assert min((table[a] != table[b]).sum() for a in range(n) for b in range(a)) >= max(1, n - 3)


def test_lm_scores(docs):
    rows = hpyp.scored(docs).collect()
    tokens = {i: [*words(lower(t or "")), None] for i, t in ROWS}
    train = Counter(x for i, t in ROWS if zlib.crc32(str(i).encode()) % 5 != 1 for x in tokens[i])
    total, distinct = sum(train.values()), len(train)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ROWS)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(x in train for x in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in own))
        assert r["score"] < 0 and r["perplexity"] > 1


def seatings(n):
    """Table sizes of every way to seat n customers."""
    if n == 0:
        yield []
        return
    for rest in seatings(n - 1):
        yield [*rest, 1]
        for k in range(len(rest)):
            yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]


@pytest.mark.parametrize("customers", [2, 3, 6])
def test_tables_are_drawn_from_their_exact_distribution(customers):
    rng, n, discount, others, base = np.random.default_rng(0), 20000, 0.6, 3, 0.2
    weight = Counter()
    for sizes in seatings(customers):
        weight[len(sizes)] += base ** len(sizes) * math.prod(hpyp.STRENGTH + discount * (others + k) for k in range(len(sizes))) * math.prod(j - discount for z in sizes for j in range(1, z))
    got = Counter(hpyp.seat(np.full(n, customers), np.full(n, float(others)), np.full(n, base), discount, rng).tolist())
    assert set(got) <= set(weight)
    assert all(abs(got[t] / n - w / weight.total()) < 0.015 for t, w in weight.items())


def test_many_customers_are_seated_by_the_restaurant_process():
    rng, n = np.random.default_rng(0), 4000
    for customers in (1, 60, 400):
        got = hpyp.seat(np.full(n, customers), np.zeros(n), np.full(n, 0.3), 0.5, rng)
        one = np.zeros(n)
        for seated in range(customers):
            fresh = (hpyp.STRENGTH + 0.5 * one) * 0.3
            one += (rng.random(n) * (fresh + seated - 0.5 * one) < fresh) if seated else 1
        assert got.min() >= 1 and abs(got.mean() - one.mean()) < 0.1 + 0.03 * one.mean()


def test_scores_are_the_averaged_predictions(docs, spark):
    """Every score again from the sampled seatings, with dictionaries and one word at a time."""
    scratch = Scratch(spark, "test-hpyp")
    frame = scratch.keep(docs.select("doc_id", "text"), "documents")
    state, _, samples, _ = hpyp.fit(frame, scratch)
    models = [(Counter(), Counter(), Counter(), Counter()) for _ in samples]  # customers and tables of pairs, tables of types and words
    for row in state.collect():
        pairs = hpyp.Pairs.of(row)
        for kept, model in zip(hpyp.unpack(row["tables"], "<i8").reshape(len(samples), -1), models):
            tables, below, top = pairs.split(kept)
            for k, (key, before) in enumerate(zip(pairs.keys.tolist(), pairs.before.tolist())):
                model[0][before, key] += int(pairs.customers[k])
                model[1][before, key] += int(tables[k])
            for k, key in enumerate(pairs.types.keys.tolist()):
                model[2][key] += int(below[k])
            for k, word in enumerate(pairs.types.words.tolist()):
                model[3][word] += int(top[k])

    def predictions(customers, tables, below, top):
        once = lambda c: min(0.95, max(0.05, (sum(x == 1 for x in c) + 0.5) / (sum(x == 1 for x in c) + 2 * sum(x == 2 for x in c) + 1)))
        type_customers, sums = Counter(), {n: Counter() for n in ("c", "t", "c2", "t2", "n3")}
        for (before, key), t in tables.items():
            type_customers[key] += t
            sums["c"][before] += customers[before, key]
            sums["t"][before] += t
        for key, t in below.items():
            sums["c2"][key & 255] += type_customers[key]
            sums["t2"][key & 255] += t
            sums["n3"][key & ~255] += t
        d1, d2 = once(customers.values()), once(type_customers.values())
        d3 = once(Counter(key & ~255 for key in type_customers).values())
        S, n3, t3 = hpyp.STRENGTH, sum(below.values()), sum(top.values())

        def chance(before, key):
            word, byte = key & ~255, key & 255
            p3 = (sums["n3"][word] - d3 * top[word] + (S + d3 * t3) / (len(top) + 1)) / (S + n3)
            p2 = (type_customers[key] - d2 * below[key] + (S + d2 * sums["t2"][byte]) * p3) / (S + sums["c2"][byte])
            return (customers[before, key] - d1 * tables[before, key] + (S + d1 * sums["t"][before]) * p2) / (S + sums["c"][before])

        return chance

    chances = [predictions(*m) for m in models]
    expected = Counter()
    for i, t in ROWS:
        key, before, _ = hpyp.pairs_of([t])
        expected[i, round(sum(math.log10(np.mean([c(b, k) for c in chances])) for k, b in zip(key.tolist(), before.tolist())), 2)] += 1
    got = Counter((r["doc_id"], round(r["score"], 2)) for r in hpyp.scored(frame).collect())
    assert got == expected


def test_model_probabilities_sum_to_one():
    keys = np.array([w << 8 | c for w in range(1, 6) for c in (0, 7)], np.uint64)
    bucket = hpyp.Bucket(keys, np.arange(1, 11))
    below, top = bucket.one_table()
    shared = hpyp.Shared(np.array(bucket.shared((below, top))))
    parent = shared.parent(np.add.reduceat(below, bucket.first), top)
    assert parent.sum() + shared.unknown() == pytest.approx(1)
    for c in (0, 7):
        here = bucket.context == c
        mass = shared.seen(bucket.context[here], bucket.customers[here], below[here]).sum() + shared.back_off(np.array([c]))[0]
        assert mass == pytest.approx(1)


def test_lm_knows_the_word_before(spark):
    """Words that end alike before them: only the word before tells which word follows."""
    rng = random.Random(4)
    follows = {f"p{k}a": f"q{k}" for k in range(40)}
    text = lambda n: " ".join(f"{p} {follows[p]}" for p in (rng.choice(sorted(follows)) for _ in range(n)))
    train, held = [[i for i in range(60) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True)]
    rows = [(i, text(60)) for i in train] + [(i, text(60)) for i in held[1:]]
    mixed = text(60).split()
    mixed[1::2] = rng.sample(mixed[1::2], 60)
    got = {r["doc_id"]: r for r in hpyp.scored(table(spark, rows + [(held[0], " ".join(mixed))])).collect()}
    assert all(got[i]["perplexity"] < 10 < got[held[0]]["perplexity"] / 2 for i in held[1:])


def test_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (hpyp.unpack_sorted(hpyp.pack_sorted(keys)) == keys).all()


def test_token_counts(docs):
    path, pattern = bpe.vocabulary()
    own = bpe.encoder(path, pattern)
    got = token_counts.token_counts(docs, path, pattern)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter((i, len(own.encode(t or ""))) for i, t in ROWS)


def test_separator_scan_over_block_bounds(spark, tmp_path):
    ids = [9, 9, 0, 0, 5, 0, 7, 7, 7, 7, 7, 0, 3]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.bin", (tmp_path / f"{n}.bin").stat().st_size) for n in "ab"], "file string, bytes long")
    for block in (1, 2, 3, 100):
        rows = token_counts.scan(files, Scratch(spark, "scan"), separator=0, block_tokens=block).orderBy("ordinal").collect()
        assert [r["n_tokens"] for r in rows] == [2, 0, 1, 5, 1] and [r["ordinal"] for r in rows] == [0, 1, 2, 3, 4]


def test_substring_dedup(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(k, " ".join(word() for _ in range(120))) for k in range(40)] + [(100, None), (101, ""), (102, "short text")]
    passage = " ".join(word() for _ in range(51))
    for k in (3, 7, 21):
        at = rng.randint(0, 119)
        w = rows[k][1].split()
        rows[k] = (k, " ".join(w[:at]) + "\n" + passage.title() + " " + " ".join(w[at:]))
    rows += [(200, rows[5][1]), (201, rows[5][1])]
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {3, 7, 21, 5, 200, 201}
    assert {r["doc_id"] for r in got if not r["remove"]} == {3, 5}
    assert {frozenset(x["doc_id"] for x in got if x["passage"] == r["passage"]) for r in got} == {frozenset({3, 7, 21}), frozenset({5, 200, 201})}


def op10_words(rows, got):
    """Words that stay of each text, and a check that its spans do not overlap."""
    left = {i: list(words(lower(t or ""))) for i, t in rows}
    for i in left:
        taken = sorted((r["start_word"], r["end_word"]) for r in got if r["doc_id"] == i)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
    for r in got:
        if r["remove"]:
            left[r["doc_id"]][r["start_word"] : r["end_word"]] = [None] * r["n_words"]
    return {i: [x for x in w if x] for i, w in left.items()}


def test_substring_dedup_leaves_one_copy_of_every_word(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, own, second = text(60), text(150), text(60)
    copy = " ".join(own[:70] + shared + own[70:])
    rows = [(5, " ".join(text(40) + shared + text(40))), (20, copy), (30, copy), (40, " ".join(text(30) + shared + second)), (50, " ".join(second)), (60, " ".join(text(60) * 3))]
    left = op10_words(rows, substring_dedup.repeated_passages(table(spark, rows)).collect())
    assert {x for w in left.values() for x in w} == {x for _, t in rows for x in words(t)}
    # the copy's own text stays once, the shared passage in the first text, the back to back one about once
    assert set(own) <= set(left[20]) and len(left[30]) < 60 and len(left[60]) < 100
    assert sum(w.count(shared[30]) for w in left.values()) == 1


def test_every_two_paragraphs_of_a_cell_are_decided():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, (6, 40)).astype(np.uint64)
    rows = [base[k % 6, : rng.integers(30, 41)].copy() for k in range(90)]
    for r in rows:
        r[rng.integers(0, len(r), rng.integers(0, 5))] = rng.integers(1, 1 << 62)
    rows = [np.unique(r) for r in rows]
    sets = [set(r.tolist()) for r in rows]
    links = {(a, b) for a in range(90) for b in range(90) if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    i, j = substring_dedup.near_in_cell(rows)
    assert set(zip(i.tolist(), j.tolist())) == links
    side = rng.integers(0, 2, 90)
    i, j = substring_dedup.near_in_cell(rows, side)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in links if side[a] != side[b]}


def test_bands_meet_nearly_all_paragraphs_alike_at_the_threshold():
    rng = random.Random(12)
    met, pairs = 0, 800
    for _ in range(pairs):
        # a word replaced inside leaves 40 of 50 shingles
        own = [f"w{rng.randrange(10**9)}" for _ in range(49)]
        other = list(own)
        other[rng.randint(5, 43)] = "x"
        p = substring_dedup.Paragraphs([" ".join(own), " ".join(other)])
        a, b = p.bands()
        met += bool((a == b).any())
    assert met >= 0.97 * pairs


@pytest.mark.parametrize("cell", [substring_dedup.CELL, 4])
def test_lines_alike_are_found_as_all_pairs_do(spark, monkeypatch, cell):
    """Edits inside, at the ends, short lines: against the exact similarity of every two lines."""
    monkeypatch.setattr(substring_dedup, "CELL", cell)
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines, rows = [], []
    for k in range(300):
        base = text(rng.choice((6, 9, 30, 60, 90)))
        if lines and rng.random() < 0.6:
            base = list(rng.choice(lines))
            for _ in range(rng.choice((0, 1, 1, 2))):
                base[rng.choice((0, len(base) - 1, rng.randrange(len(base))))] = f"x{k}"
        lines.append(base)
        rows.append((k, " ".join(base)))
    got = substring_dedup.repeated_passages(table(spark, rows), least=6).collect()
    removed = {r["doc_id"] for r in got if r["remove"]}
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    later = {k for k in range(300) if any(alike(sets[k], sets[j]) for j in range(k))}
    assert len(later & removed) >= 0.97 * len(later)
    # what else goes has a run of its words elsewhere
    runs = lambda t: {tuple(words(t)[k : k + 6]) for k in range(len(words(t)) - 5)}
    assert all(any(runs(rows[k][1]) & runs(rows[j][1]) for j in range(k)) for k in removed - later)


def test_any_role_is_read_back(spark):
    roles = ["a\0b", "a\\nb", "x\ny", "\\b\\", "<|im_end|>", "<\\|", "user"]
    turns = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(roles)], "conv_id long, turn int, role string, text string")
    back = chat_format.read_back(chat_format.formatted(turns)).first()["turns"]
    assert [(t["role"], t["text"]) for t in back] == [(r, f"t{k}") for k, r in enumerate(roles)]


def test_templated_texts_that_do_not_link(spark):
    """Thousands of texts of one template, none linked: no task compares them all."""
    rng = random.Random(13)
    template = [f"t{k}" for k in range(24)]
    rows = [(k, " ".join(template[:21] + [f"w{rng.randrange(10**12)}" for _ in range(3)])) for k in range(5000)]
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 5000


def test_chat_format(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n<|x"), (1, 1, "us\\n\ner", "<\\|im_sep|><"), (1, 1, "us\\n\ner", ""), (1, 2, None, None), (2, 5, "assistant", "x|<\\\\|\\"), (2, 6, "assistant", "y"), (None, 1, "user", "\n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.formatted(frame)).collect()}
    assert got == {1: [("user", "a<|im_end|>\n<|x"), ("us\\n\ner", ""), ("us\\n\ner", "<\\|im_sep|><"), ("", "")], 2: [("assistant", "x|<\\\\|\\"), ("assistant", "y")], None: [("user", "\n")]}
    digest = {r["conv_id"]: r for r in chat_format.digests(frame).collect()}[2]
    assert (digest["n_turns"], digest["loss_chars"], digest["loss_sha256"]) == (2, 8, hashlib.sha256("x|<\\\\|\\y".encode()).hexdigest())


def test_empty_tables(spark, empty):
    path, pattern = bpe.vocabulary()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [
        jaccard_join.jaccard_classes(empty), jaccard_join.one_of_each(empty), line_dedup.line_report(empty), line_dedup.without_repeated_lines(empty), tiling.contaminated(empty, bench),
        bpe.digests(empty, path, pattern), quality_crf.judged(empty, quality_crf.fit(empty, labels)), langid.identified(empty, langid.fit(empty)), hpyp.scored(empty),
        token_counts.token_counts(empty, path, pattern), substring_dedup.repeated_passages(empty),
        chat_format.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_null_doc_id(spark):
    frame = table(spark, [(None, "one two three four five six"), (None, None), (1, "one two three four five six")])
    path, pattern = bpe.vocabulary()
    assert jaccard_join.jaccard_classes(frame).count() == 3
    assert jaccard_join.one_of_each(frame).count() >= 2
    assert sum(r["n_dropped"] for r in line_dedup.line_report(frame).collect()) == 1
    assert hpyp.scored(frame).count() == 3 and bpe.digests(frame, path, pattern).count() == 3
    assert token_counts.token_counts(frame, path, pattern).count() == 3
    assert quality_crf.kept_documents(frame, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "one two three four five six")], "item_id long, text string")
    assert sorted((r["doc_id"] is None, r["item_id"]) for r in tiling.contaminated(frame, bench).collect()) == [(False, 1), (True, 1)]
    assert tiling.clean_documents(frame, bench).count() == 0  # the row without a text shares its null doc_id with one that goes
    assert [r["lang_pred"] for r in langid.identified(frame, langid.fit(frame)).orderBy("lang_pred").collect()] == ["en", "en", "und"]
    passage = " ".join(f"w{k}" for k in range(60))
    twice = substring_dedup.repeated_passages(table(spark, [(None, passage), (1, passage), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["remove"]) for r in twice) == [(0, False), (1, True)]


def test_columns_of_clashing_names(spark):
    """Other columns have the names the operators use themselves."""
    turns = spark.createDataFrame([(1, 0, "user", "hi", "t", 5), (1, 1, "assistant", "yo", "t", 6)], "conv_id long, turn int, role string, text string, t string, formatted int")
    assert [r["n_turns"] for r in chat_format.digests(turns).collect()] == [2]
    bench = spark.createDataFrame([(1, "one two three four five six", 7, 8)], "item_id long, text string, doc_id long, coverage long")
    frame = table(spark, [(1, "x one two three four five six y")])
    assert [r["coverage"] for r in tiling.contaminated(frame, bench).collect()] == [1.0]
    named = spark.createDataFrame([(k, "ka ro mi tu" if k % 2 else "sch ei ung ver", "xx" if k % 2 else "yy", 1, 2) for k in range(20)], "doc_id long, text string, lang string, bucket int, n int")
    assert {r["lang_pred"] for r in langid.identified(named, langid.fit(named)).collect()} == {"xx", "yy"}


def test_very_long_texts(spark):
    """Megabytes in one row: of words, and without a single space."""
    rng = random.Random(17)
    many = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    frame = table(spark, [(1, many), (2, many + " tail"), (3, "x" * 2_000_000), (4, "\n".join(["a line of words again and again"] * 50_000))])
    path, pattern = bpe.vocabulary()
    assert {r["component_id"] for r in jaccard_join.jaccard_classes(frame).collect()} == {1, 3, 4}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(frame).collect()} == {1: 0, 2: 1, 3: 0, 4: 49_999}
    assert all(r["round_trip"] for r in bpe.digests(frame, path, pattern).collect())
    assert {r["doc_id"]: r["n_tokens"] for r in hpyp.scored(frame).collect()} == {1: 300_001, 2: 300_002, 3: 2, 4: 350_001}
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(frame).collect() if r["remove"]} == {2, 4}
    assert quality_crf.judged(frame, quality_crf.ChainCRF()).where("doc_id = 4").first()["n_dup_lines"] == 49_999
    item = spark.createDataFrame([(1, " ".join(many.split()[1000:1100]))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in tiling.contaminated(frame, item).collect()) == [1, 2]
    assert {r["lang_pred"] for r in langid.identified(frame, langid.fit(frame)).collect()} == {"en"}
