"""Scalar functions, readers, sinks and plans on hand-made rows."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from swarmlens import sinks
from swarmlens.functions import repair, rules, text
from swarmlens.operators import graph, ranges
from swarmlens.plans import retrieval
from swarmlens.sources import readers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), (" a \n 　 \n b\t", "a\n\nb"), ("", "")],
)
def test_normalized(spark, raw, expected):
    assert one(spark, text.normalized("x"), raw) == expected


def test_chunks_of_edge_lengths():
    assert text.chunk("") == [] and text.chunk("  \n ") == []
    assert text.chunk("a" * 500) == ["a" * 500]
    assert [len(c) for c in text.chunk("a" * 501)] == [500, 51]
    body = "x" * 200 + "。" + "y" * 200 + ". " + "z" * 300
    assert text.chunk(body)[0].endswith("。")
    assert text.chunk("x" * 140 + ". " + "y" * 600)[0] == "x" * 140 + ". " + "y" * 358
    with pytest.raises(ValueError):
        text.chunk("abc", 100, 30)


def test_scores(spark):
    score = lambda f, t, q: one(spark, f(F.col("x"), F.lit(q)), t)
    assert score(text.match_score, "Red Fox runs", "red fox") == 100
    assert score(text.match_score, "the fox", "fox，red fox a") == 20
    assert score(text.match_score, "", "fox") == 0
    assert score(text.relevance, "red fox", "red fox") == 120
    assert score(text.relevance, "none", "x") == 0


def test_episodes(spark):
    rows = [("CREATE_POST", {"content": "hi"}), ("LIKE_POST", {"post_content": "p", "post_author_name": "Bo"}), ("LIKE_POST", {"post_content": "p"}), ("QUOTE_POST", {"original_content": "o", "quote_content": "q"}), ("FOLLOW", {}), ("WAVE", {})]
    frame = spark.createDataFrame([("Al", a, m) for a, m in rows], "n string, a string, m map<string, string>")
    got = [r[0] for r in frame.select(text.episode("n", F.col("a"), F.col("m"))).collect()]
    assert got == ['Al: posted: "hi"', 'Al: liked Bo\'s post: "p"', 'Al: liked a post: "p"', 'Al: quoted a post: "o", saying "q"', "Al: followed a user", "Al: did WAVE"]


def test_small_text_functions(spark):
    assert one(spark, text.pascal(F.col("x")), "works_at_place") == "WorksAtPlace"
    assert one(spark, text.without_thinking(F.col("x")), "<think>a\nb</think> yes ") == "yes"
    assert one(spark, text.without_fences(F.col("x")), "```json\n{}\n```") == "{}"
    assert one(spark, text.guarded_attribute(F.col("x")), "Name") == "entity_Name"
    assert one(spark, text.username(F.col("x")), "Ann Lee!").startswith("ann_lee_")
    assert one(spark, text.key_quotes(F.col("x")), "Short. This is a sentence long enough. ,but this begins with a comma. Another rather long sentence to take!") == ["Another rather long sentence to take", "This is a sentence long enough"]
    assert one(spark, rules.gender("x"), " 男 ") == "other" or one(spark, rules.gender("x"), "男") == "male"
    assert one(spark, rules.progress_class(F.col("x"), F.lit(3)), 3, "int") == "completed"


def test_json_repair():
    assert json.loads(repair.repaired('noise {"a": [1, {"b": "cut')) == {"a": [1, {"b": "cut"}]}
    assert json.loads(repair.repaired('{"a": "x\ny"} tail')) == {"a": "x y"}
    assert repair.repaired("none") is None and repair.repaired(None) is None
    assert repair.salvaged_profile('{"bio": "B", "persona": "P', "N", "T")["bio"] == "B"
    assert repair.salvaged_profile("broken", "N", "T") == {"_fixed": True, "bio": "N, T", "persona": "N is a T."}


def test_sections_and_calls():
    assert repair.clean_section("# Title\n\n---\n## Sub\ntext\n---\n", "Title") == "**Sub**\n\ntext"
    assert repair.post_processed("# A\n---\n\n\n\n# A\nb") == "# A\n\n\n\nb" or "# A" in repair.post_processed("# A\n---\n# A\nb")
    assert repair.tool_calls('x <tool_call>{"name": "quick_search", "parameters": {"q": 1}}</tool_call>') == [{"name": "quick_search", "parameters": {"q": 1}}]
    assert repair.tool_calls('{"tool": "panorama_search", "params": {}}') == [{"name": "panorama_search", "parameters": {}}]
    assert repair.tool_calls('{"name": "other"}') == [] and repair.tool_calls("plain") == []


def test_action_log(spark, tmp_path):
    folder = tmp_path / "twitter"
    folder.mkdir()
    lines = [{"round": 1, "agent_id": 2, "action_type": "CREATE_POST", "action_args": {"n": {"deep": 1}}}, {"event_type": "round_end", "round": 1}, {"round": 2, "action_type": "X"}, {"round": 3, "agent_id": 4, "action_type": "DO_NOTHING", "platform": "reddit"}]
    (folder / "actions.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n\n{"round": 4, "agen')
    rows = readers.action_log(spark, f"{folder}/*.jsonl").orderBy("round").collect()
    assert [(r["round"], r["platform"]) for r in rows] == [(1, "twitter"), (3, "reddit")]
    assert json.loads(rows[0]["action_args"]["n"]) == {"deep": 1}
    assert readers.action_log(spark, f"{folder}/*.jsonl", platform="reddit").count() == 1
    assert readers.control_events(spark, f"{folder}/*.jsonl").count() == 1
    assert [r["line"] for r in readers.agent_log(spark, str(folder / "actions.jsonl"), 1).collect()] == [1, 2, 3]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1") * 20)
    (tmp_path / "b.md").write_text("text")
    (tmp_path / "c.exe").write_text("no")
    got = {r["path"].rpartition("/")[2]: r for r in readers.documents(spark, f"{tmp_path}/*").collect()}
    assert got["b.md"]["text"] == "text" and got["a.txt"]["text"] and "unsupported" in got["c.exe"]["error"]
    whole = readers.joined_documents(readers.documents(spark, f"{tmp_path}/*")).first()["text"]
    assert "=== Document 2: b.md ===" in whole and "could not be read" in whole


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "p.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE trace (user_id INT, action TEXT, info TEXT, created_at)")
    con.executemany("INSERT INTO trace VALUES (?, ?, ?, ?)", [(1, "create_post", '{"content": "c", "junk": 1}', 5), (1, "refresh", None, 6), (2, "interview", '{"prompt": "p", "response": "r"}', "2024"), (3, "wave", "bad json", 7)])
    con.commit()
    rows = readers.new_actions(spark, path).orderBy("rowid").collect()
    assert [(r["rowid"], r["action_type"], r["action_args"]) for r in rows] == [(1, "CREATE_POST", {"content": "c"}), (3, "INTERVIEW", {}), (4, "WAVE", {})]
    assert readers.new_actions(spark, path, after=3).count() == 1
    assert [r["response"] for r in readers.interview_rows(spark, path).collect()] == ["r"]
    assert readers.platform_posts(spark, path).count() == 0 and readers.platform_comments(spark, str(tmp_path / "none.db")).count() == 0


def test_profiles_and_reports(spark, tmp_path):
    rows = [(5, "u5", "N5", "bio\nline", "bio\nline", None, None, None, None, None), (9, "u9", "N9", "b" * 200, "p", 20, "female", "ENTP", "Chile", 7)]
    frame = spark.createDataFrame(rows, "user_id long, user_name string, name string, bio string, persona string, age int, gender string, mbti string, country string, karma int")
    reddit = {r["user_id"]: r for r in sinks.reddit_profiles(frame).collect()}
    assert (reddit[5]["age"], reddit[5]["gender"], reddit[5]["mbti"], reddit[5]["karma"]) == (30, "other", "ISTJ", 1000) and len(reddit[9]["bio"]) == 150
    sinks.write_twitter(frame, str(tmp_path / "t"))
    back = readers.profiles(spark, None, str(tmp_path / "t")).orderBy("user_id").collect()
    assert [(r["user_id"], r["bio"]) for r in back] == [("0", "bio line"), ("1", "b" * 200)]
    parts = spark.createDataFrame([(2, "B", "two"), (1, "A", "one")], "section_index int, title string, body string")
    assert sinks.assembled_report("T", "S", parts).first()["report"] == "# T\n\n> S\n\n---\n\n## A\n\none\n\n## B\n\ntwo"
    sinks.write_sections(parts, str(tmp_path / "s"))


def test_graph_edges_cases(spark):
    nodes = spark.createDataFrame([("a", "A", ["Entity", "X", "Y"], ""), ("b", "", ["Node"], "s"), ("c", "C", [], "s")], "id string, name string, labels array<string>, summary string")
    edges = spark.createDataFrame([("1", "r", "f", "a", "a"), ("2", "r", "g", "a", "b"), ("3", "r", "", "longidentifier", "a")], "id string, name string, fact string, source string, target string")
    assert [(r["id"], r["entity_type"]) for r in graph.typed_entities(nodes).collect()] == [("a", "X")]
    assert [r["entity_type"] for r in graph.typed_entities(nodes, ["Y"]).collect()] == ["Y"]
    assert sorted((r["node"], r["direction"]) for r in graph.incident(edges).collect()) == [("a", "incoming"), ("a", "outgoing"), ("a", "outgoing"), ("b", "incoming"), ("longidentifier", "outgoing")]
    names = {r["id"]: (r["source_name"], r["target_name"]) for r in graph.with_short_names(edges, nodes).collect()}
    assert names == {"1": ("A", "A"), "2": ("A", "b"), "3": ("longiden", "A")}
    assert [r["id"] for r in retrieval.search_nodes(nodes, "a").collect()] == ["a"]


def test_ranks_by_ranges(spark):
    """Ranks of skewed keys, null groups and one far outlier, for few and for many ranges."""
    rng = random.Random(1)
    rows = [(k * k % 10007 if k else 10**15, rng.choice(["a", "b", None])) for k in range(500)]
    frame = spark.createDataFrame(rows, "key long, kind string")
    expected = {}
    for kind in ("a", "b", None):
        expected |= {(key, kind): i for i, key in enumerate(sorted({k for k, g in rows if g == kind}))}
    once = frame.distinct()
    for n in (1, 3, 16, 200):
        got = {(r["key"], r["kind"]): r["place"] for r in ranges.numbered(once, "key", "kind", ranges=n).collect()}
        assert got == expected
    assert ranges.numbered(frame.limit(0), "key", "kind").count() == 0


def test_log_lines_over_blocks(spark, tmp_path):
    path = tmp_path / "log.txt"
    lines = [f"line {k}" if k % 5 else "" for k in range(400)]
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.log_lines(spark, str(path), 3).orderBy("line").collect()
            assert [(r["line"], r["value"]) for r in got] == list(enumerate(lines))[3:]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sqlite_errors_are_not_empty_tables(spark, tmp_path):
    path = str(tmp_path / "q.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE post (post_id INT)")
    con.execute("INSERT INTO post VALUES (1)")
    con.commit()
    with pytest.raises(Exception, match="no such column"):
        readers.platform_posts(spark, path).collect()
