"""Declared table schemas, primary keys and the append-only flag."""

from __future__ import annotations

from pyspark.sql import types as T

META = "source string, retrieved_at_utc timestamp, source_updated_at_utc timestamp, schema_version string, content_hash string"


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<int>": T.ArrayType(T.IntegerType()),
}


def struct(columns: str) -> T.StructType:
    """``name type, ...`` to a schema, without needing a session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


def _table(columns: str) -> T.StructType:
    return struct(f"{columns}, {META}")


TABLES = {
    "games": _table(
        "game_id string, season int, week int, game_type string, kickoff_utc timestamp, away_team string, home_team string, away_score double, "
        "home_score double, result double, total double, away_rest double, home_rest double, away_moneyline int, home_moneyline int, spread_line double, "
        "away_spread_odds int, home_spread_odds int, total_line double, under_odds int, over_odds int, roof string, surface string, temp double, wind double"
    ),
    "team_metrics": _table(
        "game_id string, season int, week int, kickoff_utc timestamp, team_id string, opponent_team_id string, is_home boolean, games_available int, "
        "off_pass_epa double, def_pass_epa double, off_rush_epa double, def_rush_epa double, off_pass_success_rate double, def_pass_success_rate double, "
        "off_rush_success_rate double, def_rush_success_rate double, feature_as_of_utc timestamp, half_life double"
    ),
    "market_odds": _table(
        "snapshot_id string, provider_event_id string, game_id string, commence_time_utc timestamp, bookmaker_key string, bookmaker_title string, "
        "bookmaker_group string, market string, selection string, point double, canonical_line double, american_price int, decimal_price double, "
        "implied_probability double, vig_free_probability double, overround double, last_update_utc timestamp"
    ),
    "injuries": _table(
        "season int, week int, team_id string, player_id string, full_name string, position string, injury_status string, practice_status string, "
        "report_primary_injury string, report_secondary_injury string, snap_share_impact double, replacement_quality double"
    ),
    "player_usage": _table(
        "season int, week int, game_id string, player_id string, player_name string, team_id string, position string, offense_snaps double, "
        "offense_pct double, defense_snaps double, defense_pct double, special_teams_snaps double, special_teams_pct double"
    ),
    "coverage_metrics": _table("season int, week int, game_id string, team_id string, metric_name string, metric_value double, availability_status string"),
    "model_history": _table(
        "model_version string, created_at_utc timestamp, command string, development_end_season int, test_season int, spec_hash string, feature_hash string, "
        "artifact_path string, status string, spread_alpha double, total_alpha double, spread_brier double, spread_log_loss double, "
        "spread_market_brier double, spread_market_log_loss double, total_brier double, total_log_loss double, total_market_brier double, "
        "total_market_log_loss double, notes string"
    ),
    "market_consensus": _table(
        "snapshot_id string, provider_event_id string, game_id string, market string, anchor_line double, retail_line_mean double, consensus_line double, "
        "anchor_vig_free_probability double, retail_vig_free_probability double, consensus_probability double, same_point boolean, "
        "retail_books_count bigint, status string, dislocated_books array<string>"
    ),
    "raw_snapshots": _table("snapshot_id string, provider string, kind string, snapshot_purpose string, path string, byte_count bigint"),
    "model_predictions": _table(
        "prediction_id string, model_version string, snapshot_id string, provider_event_id string, game_id string, season int, week int, "
        "kickoff_utc timestamp, market string, orientation string, prediction_created_at_utc timestamp, snapshot_retrieved_at_utc timestamp, "
        "feature_as_of_utc timestamp, anchor_updated_at_utc timestamp, anchor_line double, anchor_orientation_price int, anchor_other_price int, "
        "anchor_orientation_no_vig_probability double, anchor_overround double, consensus_line double, consensus_probability double, "
        "consensus_status string, retail_books_count bigint, raw_adjustment double, adjustment_weight double, final_projection double, "
        "raw_non_push_win_probability double, calibrated_non_push_win_probability double, model_win_probability double, model_push_probability double, "
        "model_loss_probability double, eligibility_status string, decision string"
    ),
    "prospective_evaluations": _table(
        "evaluation_id string, model_version string, game_id string, season int, week int, kickoff_utc timestamp, market string, orientation string, "
        "prediction_id string, decision_snapshot_id string, closing_snapshot_id string, decision_line double, decision_orientation_price int, "
        "decision_other_price int, decision_market_probability double, closing_line double, closing_orientation_price int, closing_other_price int, "
        "closing_market_probability double, final_projection double, model_non_push_win_probability double, model_win_probability double, "
        "model_push_probability double, model_loss_probability double, actual_value double, result string, eligible_non_push int, exclusion_reason string, "
        "model_brier double, market_brier double, model_log_loss double, market_log_loss double, projection_error double, market_projection_error double, "
        "market_probability_movement double, decision_line_clv double, line_clv double, key_numbers_crossed array<int>, key_number_movement string, "
        "clv_status string, reconciliation_status string, closing_contract_win_probability double, closing_contract_push_probability double, "
        "closing_contract_loss_probability double, decision_price_clv double, closing_contract_ev double"
    ),
}

KEYS = {
    "games": ("game_id",),
    "team_metrics": ("game_id", "team_id"),
    "market_odds": ("snapshot_id", "provider_event_id", "bookmaker_key", "market", "selection"),
    "injuries": ("season", "week", "team_id", "player_id"),
    "player_usage": ("season", "week", "game_id", "player_id", "team_id"),
    "coverage_metrics": ("season", "week", "game_id", "team_id", "metric_name"),
    "model_history": ("model_version", "command", "created_at_utc"),
    "market_consensus": ("snapshot_id", "provider_event_id", "market"),
    "raw_snapshots": ("snapshot_id",),
    "model_predictions": ("prediction_id",),
    "prospective_evaluations": ("evaluation_id",),
}

APPEND_ONLY = {"market_odds", "model_history", "market_consensus", "raw_snapshots", "model_predictions", "prospective_evaluations"}
