"""Operators over posts, interviews, agents, configurations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions import rules
from swarmlens.operators import ranges


def agent_name(agent_id: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Agent_"), agent_id.cast("string")))


def named_actions(actions: DataFrame, agents: DataFrame) -> DataFrame:
    """Actions with the agent's configured name, else Agent_id; of repeated agents the last row by name counts."""
    names = agents.groupBy("agent_id").agg(F.max("name").alias("_name"))
    return actions.join(names, "agent_id", "left").withColumn("agent_name", agent_name(F.col("agent_id"), F.col("_name"))).drop("_name")


def _people(users: DataFrame, agents: DataFrame) -> DataFrame:
    """(user_id, author): the agent's configured name, else the user's name, else their user_name, else empty."""
    people = users.join(agents.select("agent_id", F.col("name").alias("_agent")), "agent_id", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return people.select("user_id", F.coalesce(blank("_agent"), blank("name"), blank("user_name"), F.lit("")).alias("author"))


def posts_with_author(posts: DataFrame, users: DataFrame, agents: DataFrame) -> DataFrame:
    """(post_id, content, author) of posts; without a user there is no author."""
    return posts.join(_people(users, agents), "user_id", "left").select("post_id", "content", "author")


def comments_with_author(comments: DataFrame, users: DataFrame, agents: DataFrame) -> DataFrame:
    """(comment_id, post_id, content, author) of comments; without a user there is no author."""
    return comments.join(_people(users, agents), "user_id", "left").select("comment_id", "post_id", "content", "author")


def enriched(actions: DataFrame, posts: DataFrame, users: DataFrame, agents: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Actions (seq, action_type, post_id, target_id) with what they are about: post_content, post_author, target_name.

    Likes and comments look at the post, reposts and quotes at the post's
    original, follows and mutes at the user; id 0 and unknown ids give nulls.
    With ``comments``, actions have a comment_id too, and likes and dislikes of
    a comment get comment_content and comment_author.
    """
    authored = posts_with_author(posts, users, agents)
    on_post = F.col("action_type").isin("LIKE_POST", "DISLIKE_POST", "CREATE_COMMENT")
    on_original = F.col("action_type").isin("REPOST", "QUOTE_POST")
    on_user = F.col("action_type").isin("FOLLOW", "MUTE")
    original = posts.select(F.col("post_id").alias("_post"), F.col("original_post_id").alias("_original"))
    rows = actions.join(original, F.col("post_id") == F.col("_post"), "left")
    wanted = F.when(on_post, F.col("post_id")).when(on_original, F.coalesce("_original", "post_id"))
    rows = rows.withColumns({"_about": F.nullif(wanted, F.lit(0)), "_user": F.when(on_user, F.nullif(F.col("target_id"), F.lit(0)))})
    about = authored.select(F.col("post_id").alias("_about"), F.col("content").alias("post_content"), F.col("author").alias("post_author"))
    target = users.select(F.col("user_id").alias("_user"), F.coalesce(F.nullif("name", F.lit("")), F.col("user_name")).alias("target_name"))
    rows = rows.join(about, "_about", "left").join(target, "_user", "left")
    if comments is None:
        return rows.select(*actions.columns, "post_content", "post_author", "target_name")
    on_comment = F.col("action_type").isin("LIKE_COMMENT", "DISLIKE_COMMENT")
    rows = rows.withColumn("_comment", F.when(on_comment, F.nullif(F.col("comment_id"), F.lit(0))))
    said = comments_with_author(comments, users, agents).select(F.col("comment_id").alias("_comment"), F.col("content").alias("comment_content"), F.col("author").alias("comment_author"))
    return rows.join(said, "_comment", "left").select(*actions.columns, "post_content", "post_author", "target_name", "comment_content", "comment_author")


def latest_interview(interviews: DataFrame) -> DataFrame:
    """The newest interview of each agent and platform."""
    newest = F.max_by(F.struct("conv_id", "turn", "prompt", "response"), F.struct("conv_id", "turn"))
    return interviews.groupBy("platform", "agent_id").agg(newest.alias("x")).select("platform", "agent_id", "x.*")


def interview_history(interviews: DataFrame, limit: int = 100) -> DataFrame:
    """The newest of each platform, at most ``limit`` each, merged, and the newest ``limit`` of these."""
    merged = None
    for platform in ("twitter", "reddit"):
        part = interviews.where(F.col("platform") == platform).orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)
        merged = part if merged is None else merged.unionByName(part)
    return merged.orderBy(F.desc("conv_id"), F.desc("turn")).limit(limit)


def answers(agents: DataFrame, latest: DataFrame, missing: str = "(no answer)", prefer: str = "reddit") -> DataFrame:
    """(agent_id, answer): of the preferred platform, else of the other, else a placeholder."""
    other = "twitter" if prefer == "reddit" else "reddit"
    by = latest.groupBy("agent_id").pivot("platform", ["twitter", "reddit"]).agg(F.max("response"))
    return agents.select("agent_id").join(by, "agent_id", "left").select("agent_id", F.coalesce(prefer, other, F.lit(missing)).alias("answer"))


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def batched(rows: DataFrame, ordinal: str, size: int = 15) -> DataFrame:
    """Batch of each row by its ordinal (from 0)."""
    return rows.withColumn("batch", F.floor(F.col(ordinal) / size))


def poster_assignment(posts: DataFrame, agents: DataFrame) -> DataFrame:
    """(post_id, poster_type, agent_id): posts go round the agents of their type.

    Without an agent of the type, the first alias with agents in the first
    alias group that holds the type; without any, the agent of highest
    influence (the lowest id of equals), else 0.
    """
    kinds = agents.select(F.lower("entity_type").alias("kind"), "agent_id")
    ordinal = kinds.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("agent_id")) - 1)
    sizes = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    order = []
    for g, (key, names) in enumerate(rules.POSTER_ALIASES.items()):
        for wanted in {key, *names}:
            order += [(wanted, name, 1 + g * 10 + k) for k, name in enumerate(names)]
    spark = posts.sparkSession
    table = spark.createDataFrame(order, "poster_type string, kind string, rank int")
    exact = posts.select(F.lower("poster_type").alias("poster_type")).distinct().select("poster_type", F.col("poster_type").alias("kind"), F.lit(0).alias("rank"))
    # a dozen aliases for each type of post
    choice = exact.unionByName(table.join(exact.select("poster_type"), "poster_type", "left_semi")).join(sizes, "kind")
    choice = choice.groupBy("poster_type").agg(F.min(F.struct("rank", "kind", "n")).alias("c")).select("poster_type", "c.kind", "c.n")
    rows = posts.withColumn("poster_type", F.lower("poster_type")).join(F.broadcast(choice), "poster_type", "left")  # a row a type of post
    turn = ranges.numbered(rows, "post_id", "kind").withColumnRenamed("place", "_turn")
    rows = turn.withColumn("i", F.pmod("_turn", F.coalesce("n", F.lit(1).cast("long"))))
    best = rules.agent_rules(agents).agg(F.max_by("agent_id", F.struct("influence_weight", -F.col("agent_id"))).alias("best"))
    return rows.join(ordinal, ["kind", "i"], "left").crossJoin(F.broadcast(best)).select("post_id", "poster_type", F.coalesce("agent_id", "best", F.lit(0)).alias("agent_id"))


def merged_config(agents: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """Rule fields, each replaced by the given value of the agent if there is one."""
    ruled = rules.agent_rules(agents)
    chosen = given.select("agent_id", *(F.col(f).alias(f"_{f}") for f in fields))
    return ruled.join(chosen, "agent_id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def latest_reports(reports: DataFrame) -> DataFrame:
    """(simulation_id, report_id, created_at) of each simulation's newest report."""
    newest = F.max_by(F.struct("report_id", "created_at"), F.struct("created_at", "report_id"))
    return reports.groupBy("simulation_id").agg(newest.alias("x")).select("simulation_id", "x.*")


def simulation_history(simulations: DataFrame, runs: DataFrame, projects: DataFrame, reports: DataFrame, limit: int = 20) -> DataFrame:
    """Simulations, newest first, with their run's rounds, project name and latest report."""
    rows = simulations.join(runs, "simulation_id", "left").join(projects, "project_id", "left").join(latest_reports(reports).select("simulation_id", "report_id"), "simulation_id", "left")
    rounds = F.coalesce(F.nullif("total_rounds", F.lit(0)), F.col("recommended"))
    return rows.withColumn("total_rounds", rounds).orderBy(F.desc("created_at"), "simulation_id").limit(limit)


def paged(rows: DataFrame, newest: str, id: str, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc(newest), F.desc(id)).offset(offset).limit(limit)
