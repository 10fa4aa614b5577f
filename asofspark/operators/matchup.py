"""Two entity rows per game to one matchup row, and training matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.functions.prices import fair_probability
from asofspark.functions.scalars import contains_flag, equals_flag

CONFIG = ["half_life", "prior_strength"]

# --- fixed values: offense/defense pairs of the matchup features --------------
BASE_PAIRS = {
    "pass_epa": ("off_pass_epa", "def_pass_epa"),
    "rush_epa": ("off_rush_epa", "def_rush_epa"),
    "pass_success": ("off_pass_success_rate", "def_pass_success_rate"),
    "rush_success": ("off_rush_success_rate", "def_rush_success_rate"),
}
EXTENDED_PAIRS = {
    **BASE_PAIRS,
    "neutral_rush_epa": ("off_neutral_rush_epa", "def_neutral_rush_epa"),
    "neutral_rush_success": ("off_neutral_rush_success_rate", "def_neutral_rush_success_rate"),
    "sack_risk": ("off_sack_rate", "def_sack_rate"),
    "qb_hit_risk": ("off_qb_hit_rate", "def_qb_hit_rate"),
}
ADVANCED_PAIRS = {
    "wp_pass_epa": ("off_wp_pass_epa", "def_wp_pass_epa"),
    "wp_pass_success": ("off_wp_pass_success_rate", "def_wp_pass_success_rate"),
    "cpoe": ("off_cpoe", "def_cpoe"),
    "air_epa": ("off_air_epa", "def_air_epa"),
    "yac_epa": ("off_yac_epa", "def_yac_epa"),
    "pass_explosive": ("off_pass_explosive_rate", "def_pass_explosive_rate"),
    "wp_rush_epa": ("off_wp_rush_epa", "def_wp_rush_epa"),
    "wp_rush_success": ("off_wp_rush_success_rate", "def_wp_rush_success_rate"),
    "rush_explosive": ("off_rush_explosive_rate", "def_rush_explosive_rate"),
    "short_yard_success": ("off_short_yard_success_rate", "def_short_yard_success_rate"),
    "sack_risk": ("off_sack_rate", "def_sack_rate"),
    "qb_hit_risk": ("off_qb_hit_rate", "def_qb_hit_rate"),
    "neutral_proe": ("off_neutral_proe", "def_neutral_proe_allowed"),
    "early_down_pass": ("off_early_down_pass_rate", "def_early_down_pass_rate_allowed"),
    "no_huddle": ("off_no_huddle_rate", "def_no_huddle_rate_allowed"),
    "shotgun": ("off_shotgun_rate", "def_shotgun_rate_allowed"),
    "opp_adj_pass_epa": ("off_opp_adj_pass_epa", "def_opp_adj_pass_epa"),
    "opp_adj_rush_epa": ("off_opp_adj_rush_epa", "def_opp_adj_rush_epa"),
    "opp_adj_pass_success": ("off_opp_adj_pass_success", "def_opp_adj_pass_success"),
    "opp_adj_rush_success": ("off_opp_adj_rush_success", "def_opp_adj_rush_success"),
}
FEATURE_FAMILIES = {
    "passing": ("wp_pass_epa", "wp_pass_success", "cpoe", "air_epa", "yac_epa", "pass_explosive"),
    "rushing": ("wp_rush_epa", "wp_rush_success", "rush_explosive", "short_yard_success"),
    "trenches": ("sack_risk", "qb_hit_risk"),
    "tendency": ("neutral_proe", "early_down_pass", "no_huddle", "shotgun"),
    "opponent_adjustment": ("opp_adj_pass_epa", "opp_adj_rush_epa", "opp_adj_pass_success", "opp_adj_rush_success"),
}
SPECIAL_TEAMS = ("st_epa", "st_success_rate", "st_field_goal_epa", "st_extra_point_epa", "st_punt_epa", "st_kickoff_epa")
CONTINUITY = ("off_snap_continuity", "def_snap_continuity")
CONTEXT = ("rest_difference", "is_outdoors", "is_grass")


def with_fallbacks(team_rows: DataFrame) -> DataFrame:
    """Rare rates fall back to the broader one of the same kind."""
    have = set(team_rows.columns)
    fills = {
        "off_short_yard_success_rate": "off_wp_rush_success_rate",
        "def_short_yard_success_rate": "def_wp_rush_success_rate",
        **{m: "st_epa" for m in SPECIAL_TEAMS[2:]},
    }
    return team_rows.withColumns(
        {m: F.coalesce(F.col(m), F.col(f)) for m, f in fills.items() if m in have and f in have}
    )


def sides(team_rows: DataFrame, metrics: list[str], keys: list[str], home: str = "is_home") -> DataFrame:
    """Home and away values side by side: one shuffle instead of two joins."""
    return team_rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col(home), F.col(m))).alias(f"home_{m}") for m in metrics],
        *[F.max(F.when(~F.col(home), F.col(m))).alias(f"away_{m}") for m in metrics],
        F.count_if(F.col(home)).alias("_h"),
        F.count_if(~F.col(home)).alias("_a"),
    ).filter((F.col("_h") == 1) & (F.col("_a") == 1)).drop("_h", "_a")


def matchup_columns(pairs: dict[str, tuple[str, str]], team_metrics: tuple[str, ...] = ()) -> dict:
    """Difference and sum of the two offense-versus-defense matchups."""
    out = {}
    for name, (off, deff) in pairs.items():
        home = F.col(f"home_{off}") + F.col(f"away_{deff}")
        away = F.col(f"away_{off}") + F.col(f"home_{deff}")
        out[f"{name}_matchup_difference"] = home - away
        out[f"{name}_matchup_sum"] = home + away
    for m in team_metrics:
        out[f"{m}_difference"] = F.col(f"home_{m}") - F.col(f"away_{m}")
        out[f"{m}_sum"] = F.col(f"home_{m}") + F.col(f"away_{m}")
    return out


def context_columns() -> dict:
    return {
        "rest_difference": F.col("home_rest") - F.col("away_rest"),
        "is_outdoors": equals_flag("roof", "outdoors"),
        "is_grass": contains_flag("surface", "grass"),
    }


def training_matrix(
    team_rows: DataFrame,
    games: DataFrame,
    metrics: list[str],
    features: dict,
    keys: list[str] | None = None,
) -> DataFrame:
    """One row per (game, configuration) with features, targets, lines and fair prices.

    Rows with any missing feature, target, line or price are dropped, so every
    feature subset and the market itself share one population. A price of zero
    has no fair probability and counts as missing.
    """
    config = [c for c in CONFIG if c in team_rows.columns] if keys is None else keys
    wide = sides(team_rows, metrics, ["game_id", *config])
    rows = games.filter("game_type = 'REG'").join(wide, "game_id")
    full = rows.withColumns(
        {
            **features,
            "target_margin": F.col("home_score") - F.col("away_score"),
            "target_total": F.col("home_score") + F.col("away_score"),
            "market_spread_probability": fair_probability("home_spread_odds", "away_spread_odds"),
            "market_total_probability": fair_probability("over_odds", "under_odds"),
        }
    )
    required = [*features, "target_margin", "target_total", "spread_line", "total_line", "market_spread_probability", "market_total_probability"]
    return full.select(
        "game_id", "season", "week", *config, *features, "target_margin", "target_total", "spread_line", "total_line",
        "market_spread_probability", "market_total_probability",
    ).dropna(subset=required)


def by_market(matrix: DataFrame) -> DataFrame:
    """Both markets as rows: columns market, target, line, market_probability."""
    both = F.array(
        F.struct(
            F.lit("spreads").alias("market"), F.col("target_margin").alias("target"), F.col("spread_line").alias("line"),
            F.col("market_spread_probability").alias("market_probability"),
        ),
        F.struct(
            F.lit("totals").alias("market"), F.col("target_total").alias("target"), F.col("total_line").alias("line"),
            F.col("market_total_probability").alias("market_probability"),
        ),
    )
    drop = ["target_margin", "target_total", "spread_line", "total_line", "market_spread_probability", "market_total_probability"]
    return matrix.select("*", F.inline(both)).drop(*drop)
