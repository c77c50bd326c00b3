"""Small tables and brute-force versions for the operators' tests."""

import random
import re

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, _key long, region long, sid long"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows):
    """Documents with more columns than needed, some of them of names the operators use themselves."""
    data = [(t, i, "en", "s", None if t is None else len(t), 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


def corpus(seed=1, n=60):
    """Random documents with copies, near copies, shared lines, nulls, empty texts and very long ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line = sentence(12)
    out = []
    for k in range(n):
        lines = [sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), line)
        if out and rng.random() < 0.4:
            other = rng.choice(out).split("\n")
            parts = " ".join(other).split(" ")
            for _ in range(rng.randint(0, 2)):
                parts[rng.randrange(len(parts))] = rng.choice(vocab)
            lines = [" ".join(parts)] if rng.random() < 0.5 else other
        out.append("\n".join(lines))
    long = "\n".join(sentence(40) for _ in range(150))
    rows = list(enumerate(out)) + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One two"), (1004, "one  TWO"), (1005, long), (1006, long + " x"), (1007, "Ünïcode ñandú 日本語 😀 straße " * 9)]
    rows.append(rows[3])  # a repeated row
    return rows
