"""Rules and arithmetic of rounds, agents and profiles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a simulation log calls the actions of a platform table.
ACTION_NAMES = {
    "create_post": "CREATE_POST",
    "like_post": "LIKE_POST",
    "dislike_post": "DISLIKE_POST",
    "repost": "REPOST",
    "quote_post": "QUOTE_POST",
    "follow": "FOLLOW",
    "mute": "MUTE",
    "create_comment": "CREATE_COMMENT",
    "like_comment": "LIKE_COMMENT",
    "dislike_comment": "DISLIKE_COMMENT",
    "search_posts": "SEARCH_POSTS",
    "search_user": "SEARCH_USER",
    "trend": "TREND",
    "do_nothing": "DO_NOTHING",
    "interview": "INTERVIEW",
}
IGNORED_ACTIONS = ("refresh", "sign_up")
ACTION_ARGS = ("content", "post_id", "comment_id", "quoted_id", "new_post_id", "follow_id", "query", "like_id", "dislike_id")

# Hours of a day and how active agents are in them.
QUIET_HOURS = (0, 1, 2, 3, 4, 5)
PEAK_HOURS = (19, 20, 21, 22)
PEAK_FACTOR, QUIET_FACTOR = 1.5, 0.05

# Rules by entity type, in the order (types, activity, posts and comments an hour,
# active hours, least and most minutes to respond, stance, influence).
AGENT_RULES = [
    (("university", "governmentagency", "ngo"), 0.2, 0.1, 0.05, [*range(9, 18)], 60, 240, "neutral", 3.0),
    (("mediaoutlet",), 0.5, 0.8, 0.3, [*range(7, 24)], 5, 30, "observer", 2.5),
    (("professor", "expert", "official"), 0.4, 0.3, 0.5, [*range(8, 22)], 15, 90, "neutral", 2.0),
    (("student",), 0.8, 0.6, 1.5, [8, 9, 10, 11, 12, 13, 18, 19, 20, 21, 22, 23], 1, 15, "neutral", 0.8),
    (("alumni",), 0.6, 0.4, 0.8, [12, 13, 19, 20, 21, 22, 23], 5, 30, "neutral", 1.0),
    ((), 0.7, 0.5, 1.2, [9, 10, 11, 12, 13, 18, 19, 20, 21, 22, 23], 2, 20, "neutral", 1.0),
]
RULE_FIELDS = ("activity_level", "posts_per_hour", "comments_per_hour", "active_hours", "response_delay_min", "response_delay_max", "stance", "influence_weight")

# Types of one person and types of a group.
INDIVIDUAL_TYPES = ("student", "alumni", "professor", "person", "publicfigure", "expert", "faculty", "official", "journalist", "activist")
GROUP_TYPES = ("university", "governmentagency", "organization", "ngo", "mediaoutlet", "company", "institution", "group", "community")

# Which types of agent may post for a type, best first; groups are tried in this order.
POSTER_ALIASES = {
    "official": ["official", "university", "governmentagency", "government"],
    "university": ["university", "official"],
    "mediaoutlet": ["mediaoutlet", "media"],
    "student": ["student", "person"],
    "professor": ["professor", "expert", "teacher"],
    "alumni": ["alumni", "person"],
    "organization": ["organization", "ngo", "company", "group"],
    "person": ["person", "student", "alumni"],
}

# Spellings of genders.
GENDERS = {"男": "male", "女": "female", "机构": "other", "其他": "other", "male": "male", "female": "female", "other": "other"}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def standard_action(name: str | Column) -> Column:
    """The log's name of an action; unknown ones in upper case."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(_map(ACTION_NAMES), name), F.upper(name))


def kept_args(args: str | Column) -> Column:
    return F.map_filter(args, lambda k, _: k.isin(*ACTION_ARGS))


def episode_ids(value: Column) -> Column:
    """Episodes of an edge as ids: a list of ids, a list of objects with one, or a single id."""
    objects = F.from_json(value, "array<struct<uuid: string, uuid_: string>>")
    plain = F.from_json(value, "array<string>")
    ids = F.filter(F.transform(objects, lambda x: F.coalesce(x["uuid"], x["uuid_"])), lambda x: x.isNotNull())
    named = F.when(F.size(ids) > 0, ids).otherwise(F.filter(plain, lambda x: x.isNotNull()))
    return F.when(F.ltrim(value).startswith("["), F.coalesce(named, F.array().cast("array<string>"))).otherwise(F.array(F.trim(F.translate(value, '"', ""))))


def gender(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.try_element_at(_map(GENDERS), F.lower(F.trim(value))), F.lit("other"))


def is_individual(entity_type: Column) -> Column:
    return F.coalesce(F.lower(entity_type).isin(*INDIVIDUAL_TYPES), F.lit(False))


def is_group(entity_type: Column) -> Column:
    return F.coalesce(F.lower(entity_type).isin(*GROUP_TYPES), F.lit(False))


def total_rounds(hours: Column, minutes: Column, most: int | None = None) -> Column:
    rounds = F.floor(hours * 60 / minutes)
    return rounds if most is None else F.least(rounds, F.lit(most).cast("long"))


def recommended_rounds(rounds: Column, least: int = 40) -> Column:
    return F.greatest(F.floor(rounds), F.lit(least).cast("long"))


def elapsed_label(rounds: Column, minutes: Column) -> Column:
    total = rounds * minutes
    return F.concat(F.floor(total / 60).cast("string"), F.lit("h "), (total % 60).cast("string"), F.lit("m"))


def hour_factor(hour: Column) -> Column:
    return F.when(hour.isin(*PEAK_HOURS), PEAK_FACTOR).when(hour.isin(*QUIET_HOURS), QUIET_FACTOR).otherwise(1.0)


def clock(round_column: str, minutes_per_round: int) -> list[Column]:
    """Hour of the day, day from 1 and activity factor of a round."""
    minutes = F.col(round_column) * minutes_per_round
    hour = F.pmod(F.floor(minutes / 60), F.lit(24).cast("long"))
    return [hour.alias("hour"), (F.floor(minutes / 1440) + 1).alias("day"), hour_factor(hour).alias("multiplier")]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def agent_rules(agents: DataFrame) -> DataFrame:
    """``agents`` with the rule fields of their entity_type."""
    kind = F.lower(F.coalesce("entity_type", F.lit("unknown")))
    columns = {}
    for at, name in enumerate(RULE_FIELDS):
        values = [F.array(*map(F.lit, r[at + 1])) if name == "active_hours" else F.lit(r[at + 1]) for r in AGENT_RULES]
        chosen = None
        for rule, value in zip(AGENT_RULES[:-1], values):
            test = kind.isin(*rule[0])
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        columns[name] = chosen.otherwise(values[-1])
    return agents.withColumns(columns | {"sentiment_bias": F.lit(0.0)})


def active_agents(agents: DataFrame, hour: int, round_number: int, least: int = 10, most: int = 30, seed_free: bool = True) -> DataFrame:
    """Agents of a round: those awake at ``hour`` whose draw is under their activity, lowest draws first.

    How many is ``most`` times the hour's factor, between ``least`` and
    ``most``; draws are a hash of round and agent, so the sample repeats.
    """
    factor = PEAK_FACTOR if hour in PEAK_HOURS else QUIET_FACTOR if hour in QUIET_HOURS else 1.0
    target = min(most, max(least, int(most * factor)))
    drawn = agent_rules(agents).withColumn("u", uniform(F.lit(str(round_number)), F.col("agent_id").cast("string")))
    awake = drawn.where(F.array_contains("active_hours", hour) & (F.col("u") < F.col("activity_level")))
    return awake.orderBy("u", "agent_id").limit(target).select("agent_id")


def round_agents(agents: DataFrame, rounds: int, minutes_per_round: int = 60, least: int = 10, most: int = 30) -> DataFrame:
    """(round, agent_id): who acts in each round of a simulation, as ``active_agents`` picks them; rounds are few."""
    each = agent_rules(agents).select("agent_id", "active_hours", "activity_level", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    hour = F.pmod(F.floor(F.col("round") * minutes_per_round / 60), F.lit(24).cast("long")).cast("int")
    awake = each.withColumn("hour", hour).where(F.array_contains("active_hours", F.col("hour")))
    awake = awake.withColumn("u", uniform(F.col("round").cast("string"), F.col("agent_id").cast("string"))).where("u < activity_level")
    target = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(most * hour_factor(F.col("hour")))))
    place = F.row_number().over(Window.partitionBy("round").orderBy("u", "agent_id"))
    # the constant cut lets the window drop rows before they are sorted
    return awake.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= target).select("round", "agent_id")


def back_off(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait after an attempt (from 0), without jitter."""
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(factor), attempt))


def time_config(agents: Column, low: Column, high: Column) -> list[Column]:
    """Least and most agents an hour, within the number of agents and in order."""
    most = F.least(F.greatest(high, F.lit(1)), agents)
    few = F.least(F.greatest(low, F.lit(1)), agents)
    fixed = F.when(few >= most, F.greatest(F.lit(1).cast("long"), F.floor(most / 2))).otherwise(few)
    return [fixed.alias("agents_per_hour_min"), most.alias("agents_per_hour_max")]


def progress_class(rounds: Column, total: Column) -> Column:
    return F.when(rounds <= 0, "not-started").when(rounds >= total, "completed").otherwise("in-progress")


def build_progress(stage: str, ratio: Column) -> Column:
    """Percent of a graph build: sending takes 15 to 55, processing 55 to 90."""
    if stage == "send":
        return F.lit(15) + F.floor(40 * ratio)
    return F.lit(55) + F.floor(35 * ratio)


def report_progress(done: Column, sections: Column) -> Column:
    return F.lit(20) + F.floor(70 * done / sections)
