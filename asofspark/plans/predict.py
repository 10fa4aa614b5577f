"""Prediction ledger rows: boards, features and model tables to scored contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import (
    CLOSE_WINDOW_EARLIEST, CLOSE_WINDOW_LATEST, ELIGIBLE_CLOSE_STATUS, FRESHNESS_MINUTES, ORIENTATION,
)
from asofspark.functions.prices import contract_probabilities
from asofspark.functions.scalars import all_present, stable_id
from asofspark.operators import calibrate as cal
from asofspark.operators import distribution as ds
from asofspark.operators import market as mk
from asofspark.operators.rank import prediction_status
from asofspark.operators.regression import projection


NO_DISTRIBUTION = "INELIGIBLE_NO_DISTRIBUTION"
"""Status of a row whose market has too few residuals to score it."""


def score_contracts(
    contracts: DataFrame,
    features: list[str],
    coefs: DataFrame,
    calibration: DataFrame,
    model: ds.ResidualModel,
    row_id: list[str],
    residual_target: bool = True,
    line: str = "anchor_line",
    market_probability: str = "anchor_orientation_no_vig_probability",
    market_only_at_zero: bool = False,
) -> DataFrame:
    """Features x coefficients, market weight, distribution, calibration, push split.

    coefs: market, intercept, coef, weight. calibration: market, intercept,
    slope, constant. Both hold one row per market.
    """
    cal_cols = calibration.select(
        "market", F.col("intercept").alias("_ci"), F.col("slope").alias("_cs"), F.col("constant").alias("_cc")
    )
    joined = contracts.join(coefs, "market").join(cal_cols, "market")
    raw = projection(features)
    adj = raw if residual_target else raw - F.col(line)
    projected = joined.withColumns({"raw_adjustment": adj, "adjustment_weight": F.col("weight")}).withColumn(
        "final_projection", F.col(line) + F.col("weight") * F.col("raw_adjustment")
    )
    scored = ds.score_distribution(model, projected, row_id, "final_projection", line, line)
    raw_p = ds.non_push()
    fitted = cal.calibrated("raw_non_push_win_probability", "_ci", "_cs", "_cc")
    market = F.col(market_probability) if market_only_at_zero else F.lit(None).cast("double")
    full = scored.withColumn("raw_non_push_win_probability", raw_p).withColumn(
        "calibrated_non_push_win_probability", cal.contract_probability(F.col("weight"), fitted, market)
    )
    win, loss = contract_probabilities("calibrated_non_push_win_probability", "p_push")
    return full.withColumns(
        {"model_win_probability": win, "model_push_probability": F.col("p_push"), "model_loss_probability": loss}
    ).drop("intercept", "coef", "weight", "_ci", "_cs", "_cc", "p_win", "p_push", "p_loss")


def prediction_rows(
    quotes: DataFrame,
    games: DataFrame,
    features: DataFrame,
    feature_names: list[str],
    coefs: DataFrame,
    calibration: DataFrame,
    model: ds.ResidualModel,
    version: str,
    cutoff: Column,
    created_at: Column,
    books: mk.Books = mk.Books(),
    earliest: float = CLOSE_WINDOW_EARLIEST,
    latest: float = CLOSE_WINDOW_LATEST,
    max_age_minutes: float = FRESHNESS_MINUTES,
    residual_target: bool = True,
    market_only_at_zero: bool = True,
) -> DataFrame:
    """One ledger row per (snapshot, game, market) with its eligibility.

    Where the model has no weight the market's own probability passes through.

    quotes carry game_id; games: game_id, season, week, kickoff_utc; features:
    game_id, feature_as_of_utc and the feature columns. A feature row must be
    older than the snapshot and complete, or the row is ineligible and carries
    no model values.
    """
    keys = ("snapshot_id", "provider_event_id", "game_id", "market")
    contracts = mk.anchor_contract(quotes, keys, books, max_age_minutes)
    agreed = mk.consensus(quotes, keys, books, max_age_minutes).select(
        *keys, "consensus_line", "consensus_probability", F.col("status").alias("consensus_status"), "retail_books_count"
    )
    base = (
        contracts.join(agreed, list(keys))
        .join(games.select("game_id", "season", "week", "kickoff_utc"), "game_id")
        .join(features.select("game_id", "feature_as_of_utc", *feature_names), "game_id", "left")
    )
    usable = F.coalesce(
        all_present(*feature_names) & (F.col("feature_as_of_utc") < F.col("snapshot_retrieved_at_utc")), F.lit(False)
    )
    status = prediction_status(
        F.col("reason"), F.col("contract_valid"), "kickoff_utc", "snapshot_retrieved_at_utc", cutoff, ~usable,
        earliest, latest, ELIGIBLE_CLOSE_STATUS,
    )
    graded = base.withColumn("eligibility_status", status).withColumn("_score", F.col("contract_valid") & usable)
    scored = score_contracts(
        graded.filter("_score").select(*keys, "anchor_line", "anchor_orientation_no_vig_probability", *feature_names),
        feature_names, coefs, calibration, model, ["snapshot_id", "provider_event_id", "game_id"], residual_target,
        market_only_at_zero=market_only_at_zero,
    )
    values = [
        "raw_adjustment", "adjustment_weight", "final_projection", "raw_non_push_win_probability",
        "calibrated_non_push_win_probability", "model_win_probability", "model_push_probability", "model_loss_probability",
    ]
    side = F.when(F.col("market") == "spreads", F.lit(ORIENTATION["spreads"])).otherwise(F.lit(ORIENTATION["totals"]))
    rows = graded.join(scored.select(*keys, *values), list(keys), "left")
    unscored = (F.col("eligibility_status") == ELIGIBLE_CLOSE_STATUS) & F.col("model_win_probability").isNull()
    rows = rows.withColumn("eligibility_status", F.when(unscored, NO_DISTRIBUTION).otherwise(F.col("eligibility_status")))
    return rows.select(
        stable_id(F.lit(version), "snapshot_id", "game_id", "market").alias("prediction_id"),
        F.lit(version).alias("model_version"), *keys, "season", "week", "kickoff_utc", side.alias("orientation"),
        created_at.alias("prediction_created_at_utc"), "snapshot_retrieved_at_utc", "feature_as_of_utc",
        "anchor_updated_at_utc", "anchor_line", "anchor_orientation_price", "anchor_other_price",
        "anchor_orientation_no_vig_probability", "anchor_overround",
        "consensus_line", "consensus_probability", "consensus_status", "retail_books_count", *values,
        "eligibility_status", F.lit("PASS").alias("decision"),
    )
