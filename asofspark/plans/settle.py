"""Settlement: canonical decision x independent close x result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import CLOSE_WINDOW_EARLIEST, CLOSE_WINDOW_LATEST, FRESHNESS_MINUTES
from asofspark.functions import prices as px
from asofspark.functions.scalars import content_hash, first_reason, stable_id
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators import market as mk
from asofspark.session import checkpointed

SELECTION_RULE = "latest-decision-in-window"
"""Names the rule of ``canonical_predictions`` on every record."""
TRANSIENT = ("settled_at_utc", "content_hash")


def hashed(records: DataFrame) -> DataFrame:
    return records.withColumn("content_hash", content_hash(records, TRANSIENT))


def settle(
    games: DataFrame,
    predictions: DataFrame,
    quotes: DataFrame,
    version: str,
    cutoff: Column,
    through: Column,
    model: ds.ResidualModel | None = None,
    books: mk.Books = mk.Books(),
    earliest: float = CLOSE_WINDOW_EARLIEST,
    latest: float = CLOSE_WINDOW_LATEST,
    max_age_minutes: float = FRESHNESS_MINUTES,
    settled_at: Column | None = None,
    selection_rule: str = SELECTION_RULE,
) -> DataFrame:
    """One evaluation per finished game and market.

    A record names its prediction and feature times, the rule that selected the
    decision snapshot, and the time of settlement; ``content_hash`` covers all of it but
    the settlement time, so a repeated settlement of the same facts has the same hash.

    A missing close only makes the closing-line values null; it never removes
    a scored row. Pushes and excluded rows carry no scores.
    """
    final = games.filter(
        F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
        & (F.col("kickoff_utc") > cutoff) & (F.col("kickoff_utc") <= through)
    )
    outcomes = F.inline(F.array(
        F.struct(F.lit("spreads").alias("market"), F.lit("HOME").alias("orientation"), (F.col("home_score") - F.col("away_score")).alias("actual_value")),
        F.struct(F.lit("totals").alias("market"), F.lit("OVER").alias("orientation"), (F.col("home_score") + F.col("away_score")).alias("actual_value")),
    ))
    rows = final.select("game_id", "season", "week", "kickoff_utc", outcomes)
    d_cols = [
        "prediction_id", "snapshot_id", "provider_event_id", "snapshot_retrieved_at_utc", "prediction_created_at_utc", "feature_as_of_utc",
        "anchor_line", "anchor_orientation_price", "anchor_other_price", "anchor_orientation_no_vig_probability",
        "final_projection", "calibrated_non_push_win_probability",
        "model_win_probability", "model_push_probability", "model_loss_probability",
    ]
    c_cols = [
        "snapshot_id", "provider_event_id", "snapshot_retrieved_at_utc", "anchor_line", "anchor_orientation_price",
        "anchor_other_price", "anchor_orientation_no_vig_probability",
    ]
    if "feature_as_of_utc" not in predictions.columns:
        predictions = predictions.withColumn("feature_as_of_utc", F.lit(None).cast("timestamp_ntz"))
    mine = predictions.filter(F.col("model_version") == version)
    decisions = mk.canonical_predictions(mine, latest=latest, earliest=earliest, max_age_minutes=max_age_minutes)
    closes = mk.canonical_closes(quotes, books=books, latest=latest, earliest=earliest, max_age_minutes=max_age_minutes)
    keys = ["game_id", "market"]
    joined = rows.join(decisions.select(*keys, F.struct(*d_cols).alias("d")), keys, "left").join(
        closes.select(*keys, F.struct(*c_cols).alias("c")), keys, "left"
    )
    no_decision, line = F.col("d").isNull(), F.col("d.anchor_line")
    push = F.abs(F.col("actual_value") - line) <= 1e-9
    result = F.when(no_decision, F.lit("EXCLUDED")).when(push, F.lit("PUSH")).when(
        F.col("actual_value") > line, F.lit("WIN")).otherwise(F.lit("LOSS"))
    ladder = [
        (no_decision, "MISSING_DECISION_SNAPSHOT", "UNAVAILABLE_MISSING_DECISION"),
        (F.col("c").isNull(), "MISSING_CLOSE_SNAPSHOT", "UNAVAILABLE_MISSING_CLOSE"),
        (F.col("d.snapshot_id") == F.col("c.snapshot_id"), "SNAPSHOT_NOT_INDEPENDENT", "UNAVAILABLE_NOT_INDEPENDENT"),
        (F.col("d.provider_event_id") != F.col("c.provider_event_id"), "PROVIDER_EVENT_MISMATCH", "UNAVAILABLE_EVENT_MISMATCH"),
        (F.col("c.snapshot_retrieved_at_utc") <= F.col("d.snapshot_retrieved_at_utc"), "CLOSE_NOT_AFTER_DECISION", "UNAVAILABLE_TEMPORAL_ORDER"),
    ]
    graded = joined.withColumns(
        {
            "result": result,
            "reconciliation_status": first_reason(*[(c, r) for c, r, _ in ladder], otherwise="RECONCILED"),
            "clv_status": first_reason(*[(c, s) for c, _, s in ladder], otherwise="AVAILABLE"),
        }
    )
    scored = F.col("result").isin("WIN", "LOSS")
    y = (F.col("result") == "WIN").cast("double")
    p, q = F.col("d.calibrated_non_push_win_probability"), F.col("d.anchor_orientation_no_vig_probability")
    live = F.col("clv_status") == "AVAILABLE"
    move = F.col("c.anchor_line") - line
    out = graded.select(
        stable_id(F.lit(version), "game_id", "market").alias("evaluation_id"),
        F.lit(version).alias("model_version"), "game_id", "season", "week", "kickoff_utc", "market", "orientation",
        F.col("d.prediction_id").alias("prediction_id"),
        (F.lit(None).cast("timestamp_ntz") if settled_at is None else settled_at).alias("settled_at_utc"),
        F.lit(selection_rule).alias("selection_rule_version"), F.col("d.snapshot_id").alias("canonical_snapshot_id"),
        F.col("d.prediction_created_at_utc").alias("prediction_created_at_utc"), F.col("d.feature_as_of_utc").alias("feature_as_of_utc"),
        F.col("d.snapshot_id").alias("decision_snapshot_id"), F.col("c.snapshot_id").alias("closing_snapshot_id"),
        line.alias("decision_line"), F.col("d.anchor_orientation_price").alias("decision_orientation_price"),
        F.col("d.anchor_other_price").alias("decision_other_price"), q.alias("decision_market_probability"),
        F.col("c.anchor_line").alias("closing_line"), F.col("c.anchor_orientation_price").alias("closing_orientation_price"),
        F.col("c.anchor_other_price").alias("closing_other_price"),
        F.col("c.anchor_orientation_no_vig_probability").alias("closing_market_probability"),
        F.col("d.final_projection").alias("final_projection"), p.alias("model_non_push_win_probability"),
        F.col("d.model_win_probability").alias("model_win_probability"),
        F.col("d.model_push_probability").alias("model_push_probability"),
        F.col("d.model_loss_probability").alias("model_loss_probability"),
        "actual_value", "result", scored.cast("int").alias("eligible_non_push"),
        first_reason((no_decision, "NO_VALID_DECISION_PREDICTION"), (F.col("result") == "PUSH", "PUSH_EXCLUDED_FROM_PROBABILITY_SCORING")).alias("exclusion_reason"),
        F.when(scored, ev.brier(p, y)).alias("model_brier"), F.when(scored, ev.brier(q, y)).alias("market_brier"),
        F.when(scored, ev.log_loss(p, y)).alias("model_log_loss"), F.when(scored, ev.log_loss(q, y)).alias("market_log_loss"),
        (F.col("actual_value") - F.col("d.final_projection")).alias("projection_error"),
        (F.col("actual_value") - line).alias("market_projection_error"),
        F.when(live, F.col("c.anchor_orientation_no_vig_probability") - q).alias("market_probability_movement"),
        F.when(live, move).alias("decision_line_clv"), F.when(live, move).alias("line_clv"),
        F.when(live, F.when(F.col("market") == "spreads", px.crossed_keys(line, "c.anchor_line")).otherwise(F.array().cast("array<int>"))).alias("key_numbers_crossed"),
        F.when(live, px.key_movement("market", line, "c.anchor_line")).otherwise(F.lit("UNAVAILABLE")).alias("key_number_movement"),
        "clv_status", "reconciliation_status",
    )
    null = F.lit(None).cast("double")
    if model is None:
        return hashed(out.withColumns({c: null for c in (
            "closing_contract_win_probability", "closing_contract_push_probability", "closing_contract_loss_probability",
            "decision_price_clv", "closing_contract_ev")}))
    out = checkpointed(out)  # read by the pricing and by the final join
    priced = ds.closing_anchored(
        model,
        out.filter("clv_status = 'AVAILABLE'").select(
            "game_id", "market", "closing_line", F.col("closing_market_probability").alias("closing_probability"), "decision_line"
        ),
        ["game_id"],
    ).select("game_id", "market", "closing_win", "closing_push", "closing_loss")
    full = out.join(priced, keys, "left")
    price = F.col("decision_orientation_price")
    fair = F.try_divide(F.col("closing_win"), F.col("closing_win") + F.col("closing_loss"))
    return hashed(full.withColumns(
        {
            "closing_contract_win_probability": F.col("closing_win"),
            "closing_contract_push_probability": F.col("closing_push"),
            "closing_contract_loss_probability": F.col("closing_loss"),
            "decision_price_clv": fair - px.implied_probability(price),
            "closing_contract_ev": F.col("closing_win") * (px.decimal_price(price) - 1.0) - F.col("closing_loss"),
        }
    ).drop("closing_win", "closing_push", "closing_loss"))
