"""Streams with state and timers, appended database rows, and a sink that commits once; each over a restart."""

import json
import os
import shutil
import sqlite3
import time


from swarmlens.sources import readers
from swarmlens.streaming import episodes, stateful

SCHEMA = "platform string, simulation string, seq long, text string, event_type string, round int"


def put(folder, name, rows):
    """A file appears in ``folder`` at once."""
    folder.mkdir(exist_ok=True)
    draft = folder.parent / name
    draft.write_text("".join(json.dumps(dict(zip(("platform", "simulation", "seq", "text"), r))) + "\n" for r in rows))
    draft.rename(folder / name)


def source(spark, folder):
    folder.mkdir(exist_ok=True)
    return spark.readStream.schema(SCHEMA).json(str(folder))


def run_once(frame, mode, checkpoint, out):
    """All that is there; without epochs for timers alone, which would go on for ever."""
    frame.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    frame.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert query.awaitTermination(120)


def test_batches_over_a_restart_and_out_of_order(spark, tmp_path):
    folder, out = tmp_path / "in", []
    frame = stateful.timed_batches(source(spark, folder), size=3, idle_ms=3_600_000)
    put(folder, "a.json", [("t", "s1", 4, "d"), ("t", "s1", 1, "a"), ("r", "s1", 1, "x"), ("t", "s2", 1, "p"), ("t", "s1", 2, "b"), ("t", "s1", 3, "c")])
    run_once(frame, "append", tmp_path / "cp", out)
    assert [(r["platform"], r["simulation"], r["batch"], r["n"], r["reason"], r["text"]) for r in out] == [("t", "s1", 0, 3, "full", "a\nb\nc")]
    out.clear()
    put(folder, "b.json", [("t", "s1", 6, "f"), ("t", "s1", 0, "late"), ("t", "s2", 2, None), ("t", "s2", 3, "q")])
    run_once(frame, "append", tmp_path / "cp", out)  # a new query that goes on from the checkpoint
    found = sorted((r["simulation"], r["batch"], r["n"], r["reason"], r["text"]) for r in out)
    assert found == [("s1", 1, 3, "full", "late\nd\nf"), ("s2", 0, 2, "end", "p\nq")]
    out.clear()
    put(folder, "c.json", [("r", "s1", 2, None), ("t", "s1", 7, None), ("t", "s2", 9, "again"), ("t", "s2", 10, None)])
    run_once(frame, "append", tmp_path / "cp", out)
    assert sorted((r["platform"], r["simulation"], r["batch"], r["text"]) for r in out) == [("r", "s1", 0, "x"), ("t", "s2", 1, "again")]


def test_an_idle_batch_is_flushed(spark, tmp_path):
    folder, out = tmp_path / "in", []
    put(folder, "a.json", [("t", "s1", 1, "a"), ("t", "s1", 2, "b")])
    frame = stateful.timed_batches(source(spark, folder), size=5, idle_ms=1)
    query = frame.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while not out and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [(r["batch"], r["n"], r["reason"], r["text"]) for r in out] == [(0, 2, "idle", "a\nb")]


def test_newest_and_progress(spark, tmp_path):
    folder, out = tmp_path / "in", []
    put(folder, "a.json", [("t", "s1", k, f"x{k}") for k in (5, 1, 9, 3)])
    frame = stateful.newest_actions(source(spark, folder), most=3)
    run_once(frame, "update", tmp_path / "cp", out)
    put(folder, "b.json", [("t", "s1", 7, "x7"), ("t", "s1", 0, "x0")])
    out.clear()
    run_once(frame, "update", tmp_path / "cp", out)
    assert [(r["place"], r["seq"], r["text"]) for r in sorted(out, key=lambda r: r["place"])] == [(0, 9, "x9"), (1, 7, "x7"), (2, 5, "x5")]
    rows = spark.createDataFrame([("t", "s1", None, 3), ("t", "s1", None, 5), ("t", "s1", "simulation_end", 6), ("r", "s1", None, None)], "platform string, simulation string, event_type string, round int")
    assert sorted(tuple(r) for r in stateful.progress(rows).collect()) == [("r", "s1", 1, 0, False), ("t", "s1", 2, 6, True)]


def database(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE IF NOT EXISTS trace (user_id INT, action TEXT, info TEXT, created_at TEXT)")
    con.executemany("INSERT INTO trace VALUES (?, ?, ?, ?)", rows)
    con.commit()
    con.close()


def test_appended_rows_come_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "dbs"
    folder.mkdir()
    row = lambda k: (k, "create_post", json.dumps({"content": f"c{k}"}), f"t{k}")
    database(folder / "a.db", [row(k) for k in range(10)])
    database(folder / "b.db", [row(k) for k in range(100, 103)])
    got, epochs = [], []

    def go():
        rows = readers.sqlite_changes(spark, str(folder), "trace", "rowid bigint, user_id bigint, action string", most=4, progress=str(tmp_path / "progress"), rows=3)
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: (got.extend(df.collect()), epochs.append(n))).start()
        query.processAllAvailable()
        query.stop()

    go()
    assert sorted(r["user_id"] for r in got) == [*range(10), *range(100, 103)]
    assert len(epochs) == 3  # at most four rowids of a file an epoch
    database(folder / "a.db", [row(k) for k in range(10, 15)])
    database(folder / "c.db", [row(500)])
    go()
    assert sorted(r["user_id"] for r in got) == [*range(15), 100, 101, 102, 500]
    # the last epoch was not marked as done: it runs again, and nothing after it is lost or doubled
    last = max(int(n) for n in os.listdir(tmp_path / "cp/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(tmp_path / "cp/commits" / name)
    database(folder / "c.db", [row(501)])
    before = len(got)
    go()
    again = [r["user_id"] for r in got[before:]]
    assert again.count(501) == 1 and set(again) <= {14, 500, 501, *range(8, 15)}


def test_filters_run_inside_the_database(spark, tmp_path):
    path = tmp_path / "a.db"
    database(path, [(k, "like" if k % 3 else "post", None if k % 5 == 0 else "x", str(k)) for k in range(50)])
    rows = readers.sqlite_rows(spark, str(path), "trace", "rowid bigint, user_id bigint, action string, info string")
    found = rows.where("user_id > 10 and user_id <= 40 and action = 'post' and info is not null and user_id in (12, 15, 18, 21, 39)")
    assert sorted(r["user_id"] for r in found.collect()) == [12, 18, 21, 39]
    options = {"path": str(path), "table": "trace"}
    reader = readers._SqliteReader(options, rows.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    left = list(reader.pushFilters([GreaterThan(("user_id",), 40), EqualTo(("action",), "post"), StringContains(("info",), "x")]))
    assert len(left) == 2  # the comparison of numbers is the database's alone
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [42, 45, 48]


def test_repeated_epochs_are_committed_once(spark, tmp_path):
    folder, memory, checkpoint = tmp_path / "in", str(tmp_path / "memory"), tmp_path / "cp"
    schema = "platform string, seq long, text string"

    def go():
        query = episodes.append_episodes(source(spark, folder).select("platform", "seq", "text"), memory, str(checkpoint), availableNow=True)
        assert query.awaitTermination(120)

    put(folder, "a.json", [("t", "s", k, f"e{k}") for k in range(7)])
    go()
    put(folder, "b.json", [("t", "s", k, f"e{k}") for k in range(7, 9)])
    go()
    assert sorted(r["seq"] for r in episodes.episodes(spark, memory, schema).collect()) == list(range(9))
    last = max(int(n) for n in os.listdir(checkpoint / "commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(checkpoint / "commits" / name)
    go()  # Spark does not know that the last epoch was committed, and writes it again
    assert sorted(r["seq"] for r in episodes.episodes(spark, memory, schema).collect()) == list(range(9))
    files = sum(len(r["files"]) for r in episodes.committed(spark, memory).collect())
    assert len([n for n in os.listdir(f"{memory}/files") if n.endswith(".parquet")]) == files


def test_a_failed_epoch_leaves_nothing_that_is_read(spark, tmp_path):
    import pyarrow as pa

    writer = episodes._EpisodeWriter(str(tmp_path))
    batch = pa.RecordBatch.from_arrays([pa.array(["t"]), pa.array([1]), pa.array(["x"])], names=["platform", "seq", "text"])
    lost = writer.write(iter([batch]))
    writer.abort([lost, None], 0)
    first, stray, empty = writer.write(iter([batch])), writer.write(iter([batch])), writer.write(iter([]))
    writer.commit([first, empty, None], 0)
    writer.commit([writer.write(iter([batch]))], 0)
    assert os.path.exists(stray.path) and empty.path is None
    found = episodes.episodes(spark, str(tmp_path), "platform string, seq long, text string")
    assert found.count() == 1 and episodes.committed(spark, str(tmp_path)).count() == 1
    shutil.rmtree(tmp_path / "commits")


def test_state_is_kept_by_platform_and_simulation(spark, tmp_path):
    folder, out = tmp_path / "in", []
    put(folder, "a.json", [(p, f"s{s}", k, f"{p}{s}{k}") for p in "tr" for s in range(4) for k in range(7)] + [("t", f"s{s}", 99, None) for s in range(4)])
    run_once(stateful.timed_batches(source(spark, folder), idle_ms=3_600_000), "append", tmp_path / "cp", out)
    sizes = {}
    for r in out:
        sizes.setdefault((r["platform"], r["simulation"]), []).append(r["n"])
    assert sizes == {**{("t", f"s{s}"): [5, 2] for s in range(4)}, **{("r", f"s{s}"): [5] for s in range(4)}}
