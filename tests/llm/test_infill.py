"""Fill-in-middle against a plain version, its round trip and its edge cases."""

import hashlib
import random
import re

from helpers import corpus, table

from swarmlens.llm import infill


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h[3] % 100 < 20 else "psm"
        out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        sizes = (len(p), len(m))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *sizes, digest(out), digest(text))


def test_fill_in_middle(spark):
    rng = random.Random(2)
    odd = ["a", "Bc", " ", "\n", "\x01", "\x02", "\x03", "\x04", "<", "<P", "S>", "M", ">", "é", "😀", "é", "\r\n", "\0", "$1", "\\", "7"]
    rows = corpus() + [(2000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(1, 40)))) for k in range(400)]
    rows += [(3000, "<P>"), (3001, "a<S>b"), (3002, "x<M>"), (3003, "<<P"), (3004, "\x01" * 50), (3005, "\x02\x03" * 50), (None, "no number"), (None, None)]
    rows += [(3010, "long " * 200_000), (3011, "x" * 1_000_000), (3012, "\n" * 200_000)]
    got = [tuple(r) for r in infill.digests(table(spark, rows).repartition(5)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_restore_the_texts(spark):
    rows = infill.transformed(table(spark, corpus(seed=4)), seed=9)
    assert rows.where(infill.restored(rows["output"], rows["form"]) != rows["text"]).count() == 0
    parts = rows.where("form <> 'plain'").selectExpr("length(output) - length(text) as more").distinct().collect()
    assert [r["more"] for r in parts] == [9]


def test_no_rows_and_no_python(spark):
    empty = infill.digests(table(spark, []))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
