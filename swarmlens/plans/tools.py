"""Tools by name over a graph, a pluggable language model, and the preparation of a simulation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from swarmlens.functions import render, rules, text
from swarmlens.operators import graph, simulation
from swarmlens.plans import retrieval

Tool = Callable[[DataFrame, DataFrame, dict], str | DataFrame]


def _quick(nodes: DataFrame, edges: DataFrame, p: dict) -> str:
    facts = [r["fact"] for r in retrieval.search_edges(edges, p["query"], int(p.get("limit", 10))).select("fact").collect()]
    return "\n".join([f"Query: {p['query']}", f"Found: {len(facts)}", *([""] + ["### Facts"] if facts else []), *(f"{k}. {f}" for k, f in enumerate(facts, 1))])


def _panorama(nodes: DataFrame, edges: DataFrame, p: dict) -> str:
    counts = retrieval.fact_counts(edges).first()
    top = lambda old: [r["fact"] for r in retrieval.panorama(edges, p["query"], int(p.get("limit", 50)), old).select("fact").collect()]
    return render.panorama_text(p["query"], top(False), top(True) if p.get("include_expired", True) else [], (counts["active"], counts["historical"]))


def _insight(nodes: DataFrame, edges: DataFrame, p: dict) -> str:
    facts = [r["fact"] for r in retrieval.insight_facts(edges, p["query"]).orderBy("q", "place").collect()]
    found = retrieval.insight_entities(edges, nodes, p["query"]).join(nodes.select("id", graph.entity_type().alias("kind")), "id").orderBy("id").collect()
    chains = [r["chain"] for r in retrieval.relation_chains(edges, nodes, p["query"]).orderBy("q", "place").collect()]
    return render.insight_text(p["query"], facts, [(r["name"], r["kind"] or "entity") for r in found], chains)


def _statistics(nodes: DataFrame, edges: DataFrame, p: dict) -> str:
    row = graph.sizes(nodes, edges).first()
    return f"nodes: {row['n_nodes']}, edges: {row['n_edges']}, labels: {row['n_labels']}"


def _lines(rows: DataFrame, order: str, line: str, p: dict) -> DataFrame:
    """One row: the lines in order; all of them where the parameter ``limit`` is not given."""
    if "limit" in p:
        rows = rows.orderBy(order).limit(int(p["limit"]))
    told = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("line"))))
    return rows.agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("text"))


def _by_type(nodes: DataFrame, edges: DataFrame, p: dict) -> DataFrame:
    return _lines(graph.labelled(nodes, p["entity_type"]), "id", "name", p)


def _entity(nodes: DataFrame, edges: DataFrame, p: dict) -> DataFrame:
    return _lines(retrieval.entity_view(nodes, edges, p["entity_name"]), "edge", "fact", p)


#: Tools and older names for them; searches are cut to what a reader takes, lists are a frame of one row.
TOOLS: dict[str, Tool] = {"quick_search": _quick, "panorama_search": _panorama, "insight_forge": _insight, "get_graph_statistics": _statistics, "get_entities_by_type": _by_type, "get_entity_summary": _entity}
ALIASES = {"search_graph": "quick_search", "get_simulation_context": "insight_forge"}


def tool_row(name: str, parameters: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (text) of a tool; an unknown tool or a missing parameter becomes a message."""
    tool = TOOLS.get(ALIASES.get(name, name))
    try:
        text = tool(nodes, edges, parameters) if tool else f"unknown tool: {name}; there are {', '.join(TOOLS)}"
    except KeyError as e:
        text = f"{name} needs the parameter {e}"
    return text if isinstance(text, DataFrame) else nodes.sparkSession.createDataFrame([(text,)], "text string")


def run_tool(name: str, parameters: dict, nodes: DataFrame, edges: DataFrame) -> str:
    """The text of ``tool_row``, for a caller that reads it."""
    return tool_row(name, parameters, nodes, edges).first()["text"]


def with_model(rows: DataFrame, prompt: str, model: Callable[[str], str], output: str = "answer") -> DataFrame:
    """``rows`` with a language model's answer to the column ``prompt``; failures give null, order and rows stay."""
    schema = StructType([*rows.schema.fields, StructField(output, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame[prompt]:
                try:
                    out.append(model(p))
                except Exception:  # one failed call is a missing answer
                    out.append(None)
            yield frame.assign(**{output: out})

    return rows.mapInPandas(run, schema)


def attribute_schema(attributes: list[str]) -> StructType:
    """A type for an entity's attributes, reserved names guarded."""
    return StructType([StructField(f"entity_{a}" if a.lower() in text.RESERVED else a, StringType()) for a in attributes])


def profile_rules(entities: DataFrame) -> DataFrame:
    """Profiles by rules from entities (id, name, entity_type, summary): no model is asked, draws are hashes of the name."""
    kind = F.lower("entity_type")
    young, expert = kind.isin("student", "alumni"), kind.isin("publicfigure", "expert", "faculty")
    media, body = kind.isin("mediaoutlet", "socialmediaplatform"), kind.isin("university", "governmentagency", "ngo", "organization")
    fixed = media | body
    u = rules.uniform(F.col("name"), F.lit("age"))
    span = lambda low, high: (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")
    # Topics of a kind of profile, and the spans of age above.
    topics = F.when(young, F.array(*map(F.lit, ["Education", "Social Issues", "Technology"]))).when(expert, F.array(*map(F.lit, ["Politics", "Economics", "Culture & Society"])))
    topics = topics.when(media, F.array(*map(F.lit, ["General News", "Current Events", "Public Affairs"]))).when(body, F.array(*map(F.lit, ["Public Policy", "Community", "Official Announcements"])))
    return entities.select(
        "id", "name", text.username(F.col("name")).alias("user_name"),
        F.when(fixed, F.concat(F.lit("Official account of "), "name")).otherwise(F.coalesce(F.nullif(F.left("summary", F.lit(150)), F.lit("")), F.concat("entity_type", F.lit(": "), "name"))).alias("bio"),
        F.when(young, span(18, 30)).when(expert, span(35, 60)).when(fixed, 30).otherwise(span(25, 50)).alias("age"),
        F.when(fixed, "other").when(rules.uniform(F.col("name"), F.lit("gender")) < 0.5, "male").otherwise("female").alias("gender"),
        F.when(young, "Student").when(expert, "Expert").when(media, "Media").otherwise(F.col("entity_type")).alias("profession"),
        topics.otherwise(F.array(F.lit("General"), F.lit("Social Issues"))).alias("interested_topics"),
    )


def prepared(nodes: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles and agent configurations of a graph's typed entities."""
    entities = graph.typed_entities(nodes, types)
    agents = entities.select(F.col("id").alias("agent_id"), "name", "entity_type")
    return profile_rules(entities), rules.agent_rules(agents)


def interview_plan(agents: DataFrame, latest: DataFrame, most: int = 5) -> DataFrame:
    """The first agents by id with their answers and key quotes; what a failed selection falls back to."""
    chosen = agents.orderBy("agent_id").limit(most)
    rows = simulation.answers(chosen, latest)
    return rows.withColumn("quotes", text.key_quotes(F.col("answer")))
