"""Renderers and their parsers, tools and ontologies."""

from pyspark.sql import functions as F

from swarmlens.functions import render
from swarmlens.operators import reports
from swarmlens.plans import tools
from swarmlens.sources import model


def test_round_trips(spark):
    facts = ["a fact", 'with "marks"', "3. with a number"]
    text = render.insight_text("q?", facts, [("N", "T"), ("M (x)", "U")], ["a --[r]--> b"])
    assert render.parsed_insight(text) == {"query": "q?", "facts": facts, "entities": [("N", "T"), ("M (x)", "U")], "chains": ["a --[r]--> b"]}
    assert render.parsed_panorama(render.panorama_text("q", facts, [], (3, 9))) == {"query": "q", "active": facts, "historical": [], "counts": (3, 9)}
    talk = {"agent": "A", "role": "R", "bio": "b", "question": "q?", "answer": "one\ntwo", "quotes": ["x y"]}
    assert render.parsed_interview(render.interview_text(*talk.values())) == talk
    row = spark.createDataFrame([(facts,)], "f array<string>").select(render.parsed_facts(render.facts_text(F.lit("q"), F.col("f")))).first()
    assert row[0] == facts


def test_responses(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(render.unwrapped, '{"tool_name": "t", "arguments": {"content": "inner"}}') == "inner"
    assert one(render.unwrapped, '{"tool_name": "t", "arguments": {"content": "cut') == "cut"
    assert one(render.unwrapped, "plain") == "plain"
    assert one(render.cleaned_quote, "，“a quote that is long enough”") == "a quote that is long enough"
    assert one(render.cleaned_quote, "short") is None and one(render.cleaned_quote, "about 问题3 and more") is None
    assert len(one(render.cleaned_quote, "x" * 200)) == 150
    assert one(render.answers_of, "问题1：aa\n问题2：bb") == ["aa", "bb"] and one(render.answers_of, "just one") == ["just one"]
    assert one(lambda c: render.answer_at(render.answers_of(c), 5), "only") == "only"
    assert one(render.final_answer, "thought\n<final_answer> yes </final_answer>") == "yes"
    assert one(render.final_answer, "so Final Answer: 42") == "42" and one(render.final_answer, "bare") == "bare"
    assert one(lambda c: render.short_file(c, 12), "a long file name.txt") == "a lon....txt"


def test_states_and_types(spark):
    raw = spark.createDataFrame([('{"simulation_id": "s", "current_round": 4}',), ("broken",)], "value string")
    row = reports.run_states(raw).first()
    assert (row["current_round"], row["total_rounds"], row["runner_status"], row["recent_actions"]) == (4, 0, "idle", [])
    files = spark.createDataFrame([(["state.json"], "ready", True), (list(reports.PREPARED_FILES), "ready", True)], "p array<string>, s string, g boolean")
    assert [r[0] for r in files.select(reports.is_prepared(F.col("p"), F.col("s"), F.col("g"))).collect()] == [False, True]
    types = spark.createDataFrame([([(f"T{k}", "d" * 120) for k in range(10)],), ([("Person", "p")],)], "t array<struct<name: string, description: string>>")
    got = [[t["name"] for t in r[0]] for r in types.select(reports.with_fallback_types(F.col("t"))).collect()]
    assert got == [[*(f"T{k}" for k in range(8)), "Person", "Organization"], ["Person", "Organization"]]


def test_tools(spark):
    folder = "/root/testdata/sf0.001"
    nodes, edges = model.nodes(spark, folder), model.edges(spark, folder)
    assert "Found: 10" in tools.run_tool("search_graph", {"query": "priority"}, nodes, edges)
    assert render.parsed_panorama(tools.run_tool("panorama_search", {"query": "urgent", "limit": 5}, nodes, edges))["query"] == "urgent"
    assert render.parsed_insight(tools.run_tool("insight_forge", {"query": "supplier 3"}, nodes, edges))["facts"]
    assert "unknown tool" in tools.run_tool("none", {}, nodes, edges) and "needs" in tools.run_tool("quick_search", {}, nodes, edges)
    asked = tools.with_model(nodes.limit(2), "name", lambda p: p.upper() if p.endswith("0") else 1 / 0).collect()
    assert len(asked) == 2
    profiles, configs = tools.prepared(nodes, ["Supplier"])
    assert profiles.count() == configs.count() == 10
    assert tools.attribute_schema(["Name", "age"]).names == ["entity_Name", "age"]
