"""Queries over stored actions, rollups that are kept up to date, and paged scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.operators.rollups import Rollup
from swarmlens.queries.actions import A, COUNTS, ORDER, PAGE, _timed, _times
from swarmlens.queries.files import _database
from swarmlens.queries.retrieval import E, N
from swarmlens.sources import model, paged, store
from swarmlens.sources.folders import work_folder


def _store(s, d) -> store.ActionStore:
    rows = model.actions(s, d)
    return store.write(rows, work_folder(s, "store"), rows=max(1000, rows.count() // 64))


def _deep_page(s, d) -> DataFrame:
    """Fifty actions from the middle on."""
    held = _store(s, d)
    middle = held.slices().where("platform = 'reddit'").agg(F.sum("n")).first()[0] // 2
    return held.page(50, middle, "reddit").select(*PAGE)


def _rollup(s, d) -> Rollup:
    """Actions that come in three parts, one of them twice, and are then merged with what came before."""
    rows = model.actions(s, d)
    early = Rollup(s, work_folder(s, "rollup"))
    for part in (0, 1, 0):
        early.add(f"part{part}", rows.where(F.col("seq") % 3 == part))
    late = early.merged(work_folder(s, "rollup"))
    late.add("part2", rows.where("seq % 3 = 2"))
    return late


def _renamed(df: DataFrame) -> DataFrame:
    return _times(df.withColumnsRenamed({"first_time": "first_action_time", "last_time": "last_action_time"}), "first_action_time", "last_action_time")


def _paged_nodes(s, d) -> DataFrame:
    rows = model.nodes(s, d).select("id", "name", "summary")
    path = _database(s, "nodes", "node", "uuid TEXT, name TEXT, summary TEXT", rows, "id", "uuid")
    return paged.paged_rows(s, path, "node", "uuid", "uuid string, name string, summary string", rows=700)


def _paged_edges(s, d) -> DataFrame:
    rows = model.edges(s, d).select("source", "id", "name", "fact")
    path = _database(s, "edges", "edge", "source TEXT, uuid TEXT, name TEXT, fact TEXT", rows, "id", "source")
    # by a key that many edges share
    return paged.paged_rows(s, path, "edge", "source", "uuid string, source string, fact string", page=37, rows=5000)


QUERIES = {
    "stored_history": (
        lambda s, d: _store(s, d).history("reddit", 7, (100, 600)).select(*PAGE),
        f"{A} SELECT {', '.join(PAGE)} FROM actions WHERE platform = 'reddit' AND agent_id = 7 AND round BETWEEN 100 AND 600",
    ),
    "stored_deep_page": (
        _deep_page,
        f"{A}, r AS (SELECT *, row_number() OVER ({ORDER}) AS place, count(*) OVER () AS n FROM actions WHERE platform = 'reddit') SELECT {', '.join(PAGE)} FROM r WHERE place > n // 2 AND place <= n // 2 + 50",
    ),
    "rollup_timeline": (
        lambda s, d: _renamed(_rollup(s, d).timeline()),
        f"{A} SELECT round, {COUNTS}, count(DISTINCT agent_id) AS active_agents, {_timed('\"timestamp\"')} FROM actions GROUP BY round",
    ),
    "rollup_agents": (
        lambda s, d: _renamed(_rollup(s, d).agent_stats()),
        f"{A} SELECT agent_id, max('Agent_' || agent_id) AS agent_name, {COUNTS}, {_timed('\"timestamp\"')} FROM actions GROUP BY agent_id",
    ),
    "paged_nodes": (_paged_nodes, f"{N} SELECT id AS uuid, name, summary FROM nodes"),
    "paged_edges": (_paged_edges, f"{E} SELECT id AS uuid, source, fact FROM edges"),
}
