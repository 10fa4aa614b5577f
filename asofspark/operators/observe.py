"""Fact tables to per-(period, entity) conditional means and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.fixed_values import POSITION_GROUPS, QUESTIONABLE_STATUS, SEVERE_STATUSES


@dataclass(frozen=True)
class Metric:
    """Mean of ``value`` over the facts where ``where`` holds, seen from one side.

    Both are SQL expressions. ``side`` is ``off`` for the acting entity of a
    fact and ``def`` for the entity acted upon.
    """

    name: str
    side: str
    where: str
    value: str


def both_sides(name: str, where: str, value: str, def_name: str | None = None) -> list[Metric]:
    return [
        Metric(f"off_{name}", "off", where, value),
        Metric(f"def_{def_name or name}", "def", where, value),
    ]


_PASS = "qb_dropback = 1"
_RUSH = "rush_attempt = 1 AND coalesce(qb_kneel, 0) <> 1"
PLAYED = f"({_PASS}) OR ({_RUSH})"
REGULAR = "season_type = 'REG' AND posteam IS NOT NULL AND defteam IS NOT NULL AND epa IS NOT NULL"
_NEUTRAL = "wp > 0.05 AND wp < 0.95"

BASE_METRICS = [
    *both_sides("pass_epa", _PASS, "epa"),
    *both_sides("rush_epa", _RUSH, "epa"),
    *both_sides("pass_success_rate", _PASS, "success"),
    *both_sides("rush_success_rate", _RUSH, "success"),
]
_NEUTRAL_RUSH = f"{_RUSH} AND qtr <= 3 AND abs(score_differential) <= 8"
PRESSURE_METRICS = [
    *both_sides("sack_rate", _PASS, "sack"),
    *both_sides("qb_hit_rate", _PASS, "qb_hit"),
    *both_sides("neutral_rush_epa", _NEUTRAL_RUSH, "epa"),
    *both_sides("neutral_rush_success_rate", _NEUTRAL_RUSH, "success"),
]
_WP_PASS = f"{_NEUTRAL} AND {_PASS}"
_WP_RUSH = f"{_NEUTRAL} AND {_RUSH}"
_SHORT = f"{_WP_RUSH} AND down IN (3, 4) AND ydstogo <= 2"
_SCRIMMAGE = f"{_NEUTRAL} AND (qb_dropback = 1 OR rush_attempt = 1)"
_SPECIAL = "special_teams_play = 1"
ADVANCED_METRICS = [
    *both_sides("wp_pass_epa", _WP_PASS, "epa"),
    *both_sides("wp_pass_success_rate", _WP_PASS, "success"),
    *both_sides("cpoe", _WP_PASS, "cpoe"),
    *both_sides("air_epa", _WP_PASS, "air_epa"),
    *both_sides("yac_epa", _WP_PASS, "yac_epa"),
    *both_sides("pass_explosive_rate", _WP_PASS, "cast(yards_gained >= 15 as double)"),
    *both_sides("wp_rush_epa", _WP_RUSH, "epa"),
    *both_sides("wp_rush_success_rate", _WP_RUSH, "success"),
    *both_sides("rush_explosive_rate", _WP_RUSH, "cast(yards_gained >= 10 as double)"),
    *both_sides("short_yard_success_rate", _SHORT, "success"),
    *both_sides("sack_rate", _PASS, "sack"),
    *both_sides("qb_hit_rate", _PASS, "qb_hit"),
    *both_sides("neutral_proe", _SCRIMMAGE, "pass_oe", "neutral_proe_allowed"),
    *both_sides("early_down_pass_rate", f"{_SCRIMMAGE} AND down <= 2", "qb_dropback", "early_down_pass_rate_allowed"),
    *both_sides("no_huddle_rate", _SCRIMMAGE, "no_huddle", "no_huddle_rate_allowed"),
    *both_sides("shotgun_rate", _SCRIMMAGE, "shotgun", "shotgun_rate_allowed"),
    Metric("st_epa", "off", _SPECIAL, "epa"),
    Metric("st_success_rate", "off", _SPECIAL, "success"),
    Metric("st_field_goal_epa", "off", f"{_SPECIAL} AND play_type = 'field_goal'", "epa"),
    Metric("st_extra_point_epa", "off", f"{_SPECIAL} AND play_type = 'extra_point'", "epa"),
    Metric("st_punt_epa", "off", f"{_SPECIAL} AND play_type = 'punt'", "epa"),
    Metric("st_kickoff_epa", "off", f"{_SPECIAL} AND play_type = 'kickoff'", "epa"),
]

FACT_DEFAULTS = {"season_type": ("string", "REG"), "qb_kneel": ("double", 0.0)}


def names(metrics: list[Metric]) -> list[str]:
    return [m.name for m in metrics]


def with_fact_defaults(facts: DataFrame) -> DataFrame:
    """Add the optional fact columns a slice may lack."""
    for name, (dtype, value) in FACT_DEFAULTS.items():
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(value).cast(dtype))
    return facts


def regular_facts(facts: DataFrame, actor: str = "posteam", target: str = "defteam", value: str = "epa") -> DataFrame:
    """Regular-season facts with both actors and the value known."""
    kept = with_fact_defaults(facts).filter(
        (F.col("season_type") == "REG")
        & F.col(actor).isNotNull()
        & F.col(target).isNotNull()
        & F.col(value).isNotNull()
    )
    return kept


def _measures(metrics: list[Metric]) -> list[tuple[str, str]]:
    """The distinct (predicate, value) pairs; both sides of a rate share one."""
    return list(dict.fromkeys((m.where, m.value) for m in metrics))


def fact_sums(
    facts: DataFrame,
    metrics: list[Metric],
    keys: tuple[str, ...] = ("game_id", "season", "week"),
    actor: str = "posteam",
    target: str = "defteam",
    keep: str | None = None,
    only: str | None = None,
    extra: list[Column] | None = None,
) -> DataFrame:
    """Sums and counts per (keys, actor, target): the one pass over the facts.

    Folds map-side, so a hot pair of entities costs one row per task. ``only``
    restricts the measures (not the rows) to facts where it holds; ``extra``
    adds further aggregates to the same pass.
    """
    only = only or "true"
    measures = _measures(metrics)
    aggs = []
    for i, (where, value) in enumerate(measures):
        x = F.when(F.expr(f"({only}) AND ({where})"), F.expr(value)).cast("double")
        aggs += [F.sum(x).alias(f"_s{i}"), F.count(x).alias(f"_c{i}")]
    kept = F.count_if(F.expr(f"({only}) AND ({keep or 'true'})")).alias("_keep")
    return facts.groupBy(*keys, actor, target).agg(*aggs, kept, *(extra or []))


def entity_means(
    sums: DataFrame,
    metrics: list[Metric],
    keys: tuple[str, ...] = ("game_id", "season", "week"),
    actor: str = "posteam",
    target: str = "defteam",
    entity: str = "team_id",
) -> DataFrame:
    """Means per entity, each row of the compact sums seen from both its sides."""
    index = {mv: i for i, mv in enumerate(_measures(metrics))}
    sides = F.explode(
        F.array(
            F.struct(F.lit("off").alias("side"), F.col(actor).alias("id")),
            F.struct(F.lit("def").alias("side"), F.col(target).alias("id")),
        )
    )

    def mean(m: Metric) -> Column:
        i = index[(m.where, m.value)]
        mine = F.col("_e.side") == m.side
        return F.try_divide(F.sum(F.when(mine, F.col(f"_s{i}"))), F.sum(F.when(mine, F.col(f"_c{i}")))).alias(m.name)

    out = (
        sums.withColumn("_e", sides)
        .groupBy(*keys, F.col("_e.id").alias(entity))
        .agg(*[mean(m) for m in metrics], F.sum("_keep").alias("_keep"))
    )
    return out.filter(F.col("_keep") > 0).drop("_keep")


def observe(
    facts: DataFrame,
    metrics: list[Metric],
    keys: tuple[str, ...] = ("game_id", "season", "week"),
    actor: str = "posteam",
    target: str = "defteam",
    entity: str = "team_id",
    keep: str | None = None,
) -> DataFrame:
    """All metrics of both sides from one scan and two small shuffles.

    ``keep`` restricts the result to entities having at least one fact, on
    either side, for which the SQL predicate holds.
    """
    sums = fact_sums(facts, metrics, keys, actor, target, keep)
    return entity_means(sums, metrics, keys, actor, target, entity)


def base_observations(facts: DataFrame, **kw) -> DataFrame:
    return observe(regular_facts(facts), BASE_METRICS, keep=PLAYED, **kw)


def extended_observations(facts: DataFrame, **kw) -> DataFrame:
    """Base metrics plus pressure and neutral-script rates, on the base rows."""
    return observe(regular_facts(facts), BASE_METRICS + PRESSURE_METRICS, keep=PLAYED, **kw)


def advanced_observations(facts: DataFrame, **kw) -> DataFrame:
    """The advanced rates for every entity with any regular fact."""
    return observe(regular_facts(facts), ADVANCED_METRICS, **kw)


def category_counts(
    statuses: DataFrame,
    keys: tuple[str, ...] = ("season", "week", "team_id"),
    position: str = "position",
    status: str = "injury_status",
) -> DataFrame:
    """Five counters of position group by severity; zero, not null, when empty."""
    severe = F.col(status).isin(*SEVERE_STATUSES)
    return statuses.groupBy(*keys).agg(
        *[F.count_if(severe & F.col(position).isin(*group)).alias(name) for name, group in POSITION_GROUPS.items()],
        F.count_if(F.col(status) == QUESTIONABLE_STATUS).alias("questionable_players"),
    )


def share_continuity(
    usage: DataFrame,
    schedule: DataFrame,
    shares: dict[str, str],
    game: str = "game_id",
    season: str = "season",
    entity: str = "team_id",
    member: str = "player_id",
    ts: str = "kickoff_dt",
) -> DataFrame:
    """Overlap of member shares with the entity's previous game.

    ``shares`` maps share columns to output names. The denominator is the
    current game's share sum; a member absent from the previous game adds
    nothing. Game order counts only games present in ``usage``.
    """
    seen = usage.select(game, entity).distinct()
    numbered = schedule.join(seen, [game, entity], "left_semi").select(
        season,
        entity,
        game,
        F.row_number().over(Window.partitionBy(entity, season).orderBy(ts, game)).alias("game_number"),
    )
    current = usage.select(
        season, game, entity, member, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in shares]
    ).join(numbered, [season, game, entity])
    previous = current.select(
        season,
        entity,
        member,
        (F.col("game_number") + 1).alias("game_number"),
        *[F.col(c).alias(f"_prev_{c}") for c in shares],
    )
    paired = current.join(previous, [season, entity, member, "game_number"], "left")
    sums = paired.groupBy(season, game, entity, "game_number").agg(
        *[F.sum(c).alias(f"_den_{c}") for c in shares],
        *[F.sum(F.least(F.col(c), F.coalesce(F.col(f"_prev_{c}"), F.lit(0.0)))).alias(f"_num_{c}") for c in shares],
    )
    later = F.col("game_number") > 1
    return sums.select(
        season,
        game,
        entity,
        *[
            F.when(later & (F.col(f"_den_{c}") > 0), F.col(f"_num_{c}") / F.col(f"_den_{c}")).alias(out)
            for c, out in shares.items()
        ],
    )
