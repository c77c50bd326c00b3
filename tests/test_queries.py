"""Every query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import json
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from swarmlens import registry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" and hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(value(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, str(FOLDER)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    expected = oracle.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert comparable(got) == comparable(expected)


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_json_repair_rows(spark):
    """What SQL can't express: cut-off objects, closed where they were cut."""
    events = pd.read_parquet(FOLDER / "events.parquet")
    expected = {}
    for i, props in zip(events["event_id"], events["props"]):
        whole = json.loads(props) if i % 2 == 0 else {"a": ["x", {"p": json.loads(props), "q": "cut"}]}
        expected[i] = json.dumps(whole, ensure_ascii=False, sort_keys=True)
    got = {r["event_id"]: r["json"] for r in registry.queries()["json_repair"](spark, str(FOLDER)).collect()}
    assert got == expected


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
def test_section_clean_rows(spark):
    docs = pd.read_parquet(FOLDER / "documents.parquet")
    got = {(r["doc_id"], r["digest"]) for r in registry.queries()["section_clean"](spark, str(FOLDER)).collect()}
    checked = 0
    for i, text in zip(docs["doc_id"], docs["text"]):
        lines = (text or "").strip().split("\n")
        if text is None or any(re.match(r"#{1,6}\s", x.strip()) for x in lines):
            continue
        while lines and lines[-1].strip() in ("", "---", "***", "___"):
            lines.pop()
        assert (i, hashlib.md5("\n".join(["**Part**", "", *lines]).rstrip("\n").encode()).hexdigest()) in got
        checked += 1
    assert checked > 100
