"""The action store, rollups and paged scans against plain versions."""

import datetime
import random
import sqlite3

import pytest

from swarmlens.operators import actions as ops
from swarmlens.operators.rollups import Rollup
from swarmlens.sources import paged, store

SCHEMA = "seq long, platform string, agent_id long, agent_name string, action_type string, timestamp timestamp_ntz, round long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    out = []
    for k in range(3000):
        hour = 7 if rng.random() < 0.4 else rng.randrange(200)  # many actions of one time
        agent = 5 if hour == 150 else rng.randrange(400) if rng.random() < 0.5 else 999
        out.append((k, rng.choice(["twitter", "reddit"]), agent, f"name{k % 7}", rng.choice("abc"), start + datetime.timedelta(hours=hour), hour))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def held(frame, tmp_path_factory):
    return store.write(frame, f"file://{tmp_path_factory.mktemp('store')}/s", rows=100)


def test_pages_of_any_depth(frame, held):
    order = [r["seq"] for r in ops.newest_first(frame).collect()]
    for limit, offset in ((10, 0), (50, 1470), (7, 2998), (5, 3000)):
        page = held.page(limit, offset)
        assert [r["seq"] for r in page.collect()] == order[offset : offset + limit]
        assert len(page.inputFiles()) <= 2
    reddit = [r["seq"] for r in ops.newest_first(frame.where("platform = 'reddit'")).collect()]
    assert [r["seq"] for r in held.page(30, 700, "reddit").collect()] == reddit[700:730]


def test_histories_read_the_files_that_hold_them(rows, held):
    every = len(held.actions().inputFiles())
    assert every >= 20
    for platform, agent, rounds in (("twitter", 5, None), (None, 999, (20, 60)), ("reddit", 17, None), (None, 123456, None), (None, None, (7, 7))):
        found = held.history(platform, agent, rounds)
        expected = [r[0] for r in rows if platform in (None, r[1]) and agent in (None, r[2]) and (rounds is None or rounds[0] <= r[6] <= rounds[1])]
        assert sorted(r["seq"] for r in found.collect()) == expected
        assert len(held.files(platform, agent, rounds)) <= min(every - 1, max(1, len(expected)))
    plan = held.history("twitter", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(agent_id,5)" in plan


def test_merged_rollups_are_those_of_all_actions(spark, frame, rows, tmp_path):
    kept = Rollup(spark, f"file://{tmp_path}/a")
    for part in (0, 1, 2, 1):
        kept.add(f"p{part}", frame.where(frame["seq"] % 3 == part))
    kept = kept.merged(f"file://{tmp_path}/b")
    expected = sorted(tuple(r) for r in ops.timeline(frame).collect())
    assert sorted(tuple(r) for r in kept.timeline().collect()) == expected
    about = {r["round"]: r["active_agents"] for r in kept.timeline(exact=False).collect()}
    assert all(abs(about[r[0]] - r[4]) <= 0.05 * r[4] for r in expected)
    assert sorted(tuple(r) for r in kept.agent_stats().collect()) == sorted(tuple(r) for r in ops.agent_stats(frame).collect())
    assert sorted(tuple(r) for r in kept.action_types().collect()) == sorted(tuple(r) for r in ops.histogram(frame, "round").collect())


def test_sketches_of_many_agents(spark, tmp_path):
    many = spark.range(60_000).selectExpr("id AS seq", "'twitter' AS platform", "id % 20000 AS agent_id", "'x' AS agent_name", "'a' AS action_type", "timestamp_ntz'2024-01-01 00:00:00' AS timestamp", "1L AS round")
    kept = Rollup(spark, f"file://{tmp_path}")
    for part in (0, 1):
        kept.add(str(part), many.where(f"seq % 2 = {part}"))
    assert kept.timeline().first()["active_agents"] == 20000
    assert kept.timeline(exact=False).first()["active_agents"] == pytest.approx(20000, rel=0.06)


def test_paged_scans(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE node (uuid TEXT, name TEXT)")
    rows = [(None if k % 41 == 0 else f"k{k % 37:02d}", f"n{k}") for k in range(400)]  # few different cursors
    con.executemany("INSERT INTO node VALUES (?, ?)", rows)
    con.commit()
    con.close()
    for page, ranges in ((1, 1000), (7, 50), (20, 20), (400, 1000), (401, 3)):
        found = paged.paged_rows(spark, str(tmp_path), "node", "uuid", "uuid string, name string", page=page, rows=ranges)
        assert sorted((r["uuid"] or "", r["name"]) for r in found.collect()) == sorted((u or "", n) for u, n in rows)
    assert paged.paged_rows(spark, str(tmp_path), "nothing", "uuid", "uuid string").count() == 0


def test_the_compatible_cap_and_pages_that_fail(spark, tmp_path, monkeypatch):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE node (uuid INT)")
    con.executemany("INSERT INTO node VALUES (?)", [(k,) for k in range(2500)])
    con.commit()
    con.close()
    found = paged.paged_rows(spark, str(tmp_path / "a.db"), "node", "uuid", "uuid bigint", compat=True)
    assert [r["uuid"] for r in found.orderBy("uuid").collect()] == list(range(2000))
    reader = paged._PagedReader({"path": str(tmp_path / "a.db"), "table": "node", "key": "uuid", "delay": "0"}, found.schema)
    part, calls, own = reader.partitions()[0], [], reader._run

    def fails(path, sql, args=()):
        calls.append(1)
        if len(calls) % 3:
            raise sqlite3.OperationalError("database is locked")
        return own(path, sql, args)

    monkeypatch.setattr(reader, "_run", fails)
    assert len(reader.fetch(part, None)) == 100 and len(calls) == 3
    monkeypatch.setattr(reader, "_run", lambda *a: [(5, 5, 5)] * 100)
    with pytest.raises(ValueError):
        list(reader.read(part))
