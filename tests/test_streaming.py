"""Streams give what the batch operators give."""

import json

from pyspark.sql import functions as F

from swarmlens.streaming import actions as streams


def run(frame, mode, tmp_path, name):
    out = []
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    query.processAllAvailable()
    query.stop()
    return out


def record(k, **more):
    return json.dumps({"round": k // 3, "timestamp": f"2024-01-01T00:{k:02d}:00", "agent_id": k % 4, "action_type": "CREATE_POST"} | more)


def test_tail_holds_back_a_torn_line(spark, tmp_path):
    folder = tmp_path / "logs" / "twitter"
    folder.mkdir(parents=True)
    log = folder / "actions.jsonl"
    log.write_text(record(1) + "\n" + record(2) + "\n" + record(3)[:20])
    rows = streams.parsed(streams.log_stream(spark, str(tmp_path / "logs")))
    assert len(run(rows, "append", tmp_path, "tail")) == 2
    with log.open("a") as f:
        f.write(record(3)[20:] + "\n" + json.dumps({"event_type": "simulation_end"}) + "\n")
    assert len(run(rows, "append", tmp_path, "tail")) == 2


def test_parts_of_a_log_hold_each_line_once(tmp_path, monkeypatch):
    folder = tmp_path / "twitter"
    folder.mkdir()
    lines = [f"line {k} " + "x" * (k % 9) for k in range(50)]
    (folder / "a.jsonl").write_text("\n".join(lines) + "\ntorn")
    reader = streams._TailReader({"path": str(tmp_path)})
    for size in (1, 7, 40, 10_000):
        monkeypatch.setattr(streams._TailReader, "PART_BYTES", size)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [t for p in parts for _, t in reader.read(p)] == lines


def test_running_state_and_batches(spark, tmp_path):
    folder = tmp_path / "logs" / "reddit"
    folder.mkdir(parents=True)
    (folder / "actions.jsonl").write_text("".join(record(k) + "\n" for k in range(12)) + json.dumps({"event_type": "simulation_end"}) + "\n")
    rows = streams.parsed(streams.log_stream(spark, str(tmp_path / "logs")))
    state = run(streams.run_state(rows), "update", tmp_path, "state")[-1]
    assert (state["platform"], state["actions"], state["current_round"], state["completed"]) == ("reddit", 12, 3, True)
    assert len(json.loads(state["recent"])) == 12
    texts = rows.select("platform", F.when(F.col("event_type").isNull(), F.col("agent_id").cast("string")).alias("text"))
    batches = run(streams.count_batches(texts), "append", tmp_path, "batches")
    assert [(b["batch"], b["n"]) for b in batches] == [(0, 5), (1, 5), (2, 2)]


def test_windows_and_dedupe(spark, tmp_path):
    folder = tmp_path / "logs" / "reddit"
    folder.mkdir(parents=True)
    (folder / "actions.jsonl").write_text("".join(record(k) + "\n" for k in (1, 1, 2, 3)))
    rows = streams.parsed(streams.log_stream(spark, str(tmp_path / "logs")))
    assert len(run(streams.deduplicated(rows), "append", tmp_path, "dedupe")) == 3
    counts = run(streams.windowed(rows), "update", tmp_path, "windows")
    assert [c["n"] for c in counts] == [4]
