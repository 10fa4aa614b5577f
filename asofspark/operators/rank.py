"""Candidates, ranking, drift, attribution and ratings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import MIN_EDGE
from asofspark.functions import prices as px
from asofspark.functions.scalars import conservative_probability, first_reason, minutes_between
from asofspark.operators.scan import row_numbers


def candidates(contracts: DataFrame, carry: list[str]) -> DataFrame:
    """Both selections of every scored contract.

    contracts: market, orientation and other (structs of american_price, point,
    vig_free_probability), p_non_push, p_push, raw_adjustment,
    adjustment_weight, plus ``carry``.
    """
    weighted = F.col("raw_adjustment") * F.col("adjustment_weight")
    first = F.when(F.col("market") == "spreads", F.lit("HOME")).otherwise(F.lit("OVER"))
    second = F.when(F.col("market") == "spreads", F.lit("AWAY")).otherwise(F.lit("UNDER"))
    two = contracts.select(
        *carry, "market", "p_push", "raw_adjustment", "adjustment_weight",
        F.inline(F.array(
            F.struct(first.alias("selection"), F.col("orientation").alias("_q"), F.col("p_non_push").alias("model_probability")),
            F.struct(second.alias("selection"), F.col("other").alias("_q"), (1 - F.col("p_non_push")).alias("model_probability")),
        )),
    )
    win, loss = px.contract_probabilities("model_probability", "p_push")
    net = px.net_profit("_q.american_price")
    return two.select(
        *carry, "market", "selection",
        F.col("_q.point").alias("offered_point"),
        F.col("_q.american_price").alias("price"),
        net.alias("net_decimal_profit"),
        px.break_even("_q.american_price").alias("break_even_probability"),
        "model_probability", win.alias("model_win_probability"), F.col("p_push").alias("push_probability"), loss.alias("model_loss_probability"),
        F.col("_q.vig_free_probability").alias("market_fair_probability"),
        (F.col("model_probability") - F.col("_q.vig_free_probability")).alias("probability_edge"),
        px.expected_roi(win, loss, net).alias("expected_roi"),
        weighted.alias("weighted_adjustment"),
        px.signal_source("adjustment_weight").alias("signal_source"),
        px.direction("selection", weighted).alias("football_direction"),
    )


def conservative(cands: DataFrame) -> DataFrame:
    """Margin-reduced probability, edge and return of each candidate."""
    c = conservative_probability("model_probability", "probability_margin")
    win, loss = px.contract_probabilities(c, "push_probability")
    return cands.withColumns(
        {
            "conservative_probability": c,
            "conservative_edge": c - F.col("market_fair_probability"),
            "conservative_roi": px.expected_roi(win, loss, F.col("net_decimal_profit")),
        }
    )


def rank_candidates(
    cands: DataFrame, roi: str = "conservative_roi", edge: str = "conservative_edge", top: int | None = 5,
    complete: Column | None = None, min_edge: float = MIN_EDGE,
) -> DataFrame:
    """Qualified candidates, one per (game, market), best return first.

    The exposure rule is an aggregate (``min_by`` over the full order), so a
    hot exposure folds map-side; only its winners are sorted.
    """
    good = (F.col(edge) >= min_edge) & (F.col(roi) > 0)
    if complete is not None:
        good = good & complete
    rest = [c for c in cands.columns if c not in ("game_id", "market")]
    order = F.struct((-F.col(roi)).alias("a"), (-F.col(edge)).alias("b"), "selection", "book")
    best = cands.filter(good).groupBy("game_id", "market").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("game_id", "market", "_r.*")
    ordered = best.orderBy(F.col(roi).desc(), F.col(edge).desc(), "game_id", "market", "selection", "book")
    return ordered.limit(top) if top else ordered


def evidence_counts(cands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Zero-filled counts of every evidence label."""
    labels = {
        "signal_source": ("MARKET_CALIBRATION_ONLY", "FOOTBALL_ADJUSTED"),
        "football_direction": ("SUPPORTS_SELECTION", "OPPOSES_SELECTION", "NEUTRAL"),
    }
    return cands.groupBy(*keys).agg(
        *[F.count_if(F.col(c) == v).alias(v.lower()) for c, vs in labels.items() for v in vs]
    )


def linear(x: Column, intercept: Column, coefs: Column) -> Column:
    """Projection of a linear model for an array of features."""
    return F.aggregate(F.zip_with(x, coefs, lambda v, c: v * c), intercept.cast("double"), lambda acc, v: acc + v)


def component_disagreement(*projections: str) -> Column:
    """Spread between the projections of several models of one row."""
    return F.greatest(*projections) - F.least(*projections)


def feature_drift(rows: DataFrame, features: list[str], profile: DataFrame, row_id: list[str], components: tuple[str, ...] = ()) -> DataFrame:
    """Largest |z| and number of features outside the training range per row.

    ``profile`` (feature, mean, std, min, max) has one row per feature: it is
    folded into one map row and read by the rows as a scalar. ``components`` name
    columns with the projections of the row's models; their spread is added as
    component_disagreement.
    """
    packed = profile.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std", "min", "max").alias("p")))).alias("m")
    )
    z, outside = [], []
    for f in features:
        p = F.col("_m")[f]
        sd = F.when(p["std"] > 0, p["std"]).otherwise(1.0)
        z.append(F.abs((F.col(f) - p["mean"]) / sd))
        outside.append(((F.col(f) < p["min"]) | (F.col(f) > p["max"])).cast("int"))
    total = outside[0]
    for o in outside[1:]:
        total = total + o
    largest = F.greatest(*z) if len(z) > 1 else z[0]
    spread = [component_disagreement(*components).alias("component_disagreement")] if components else []
    return rows.withColumn("_m", packed.scalar()).select(
        *row_id, largest.alias("feature_drift_max_abs_z"), total.alias("feature_outside_training_range"), *spread
    )


def strongest(entries: Column, top: int) -> Column:
    """The entries (feature, contribution) of the greatest size, then by name, as an array."""
    def key(e: Column) -> Column:
        return F.struct((-F.abs(e["contribution"])).alias("a"), e["feature"].alias("b"), e["contribution"].alias("c"))

    ordered = F.slice(F.sort_array(F.transform(entries, key)), 1, top)
    return F.transform(ordered, lambda e: F.struct(e["b"].alias("feature"), e["c"].alias("projection_contribution")))


def _driver_rows(rows: DataFrame, drivers: Column, row_id: list[str]) -> DataFrame:
    return rows.select(*row_id, F.posexplode(drivers).alias("pos", "_e")).select(*row_id, (F.col("pos") + 1).alias("driver_rank"), "_e.*")


def attribution(rows: DataFrame, features: list[str], coefs: dict[str, float] | Column, means: dict[str, float] | Column, row_id: list[str], top: int = 3) -> DataFrame:
    """Change of a linear projection when each feature is set to its training mean.

    Contributions are compared inside the row's own small array, so nothing is
    shuffled. ``coefs`` and ``means`` are maps by feature (literal or column).
    """
    def value(source, f: str) -> Column:
        return F.lit(float(source[f])) if isinstance(source, dict) else source[f]

    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (value(coefs, f) * (F.col(f) - value(means, f))).alias("contribution"))
            for f in sorted(features)
        ]
    )
    return _driver_rows(rows, strongest(entries, top), row_id)


def model_drivers(features: list[str], means: Column, predict: Callable[[Column], Column], top: int = 3) -> Column:
    """The strongest drivers of any model's projection, as an array column.

    ``predict`` maps an array of feature values to a projection: a linear model,
    a tree ensemble held as a table, or a blend. Every feature is set to its training
    mean in turn and the row is scored again; all of it stays in the row's own arrays.
    """
    x = [F.col(f).cast("double") for f in features]

    def entry(i: int) -> Column:
        changed = F.array(*[F.get(means, F.lit(j)) if j == i else v for j, v in enumerate(x)])
        return F.struct(F.lit(features[i]).alias("feature"), (predict(F.array(*x)) - predict(changed)).alias("contribution"))

    return strongest(F.array(*[entry(i) for i in range(len(features))]), top)


def model_attribution(rows: DataFrame, features: list[str], means: Column, predict: Callable[[Column], Column], row_id: list[str], top: int = 3) -> DataFrame:
    """One row per driver of :func:`model_drivers`."""
    return _driver_rows(rows, model_drivers(features, means, predict, top), row_id)


def against_average(latest: DataFrame, metrics: list[str], entity: str = "team_id") -> DataFrame:
    """Each entity at home against the average opponent, as matchup input columns.

    The average row is one scalar struct per table, not a join.
    """
    average = latest.agg(F.struct(*[F.avg(m).alias(m) for m in metrics]).alias("a"))
    return latest.withColumn("_a", average.scalar()).select(
        entity, *[F.col(m).alias(f"home_{m}") for m in metrics], *[F.col(f"_a.{m}").alias(f"away_{m}") for m in metrics]
    )


def neutral_ratings(projected: DataFrame, value: str, entity: str = "team_id") -> DataFrame:
    """Centred rating and deterministic rank of every entity, without a one-task sort."""
    mean = projected.agg(F.avg(value).alias("m"))
    centred = projected.withColumn("rating", F.col(value) - mean.scalar())
    return row_numbers(centred, [F.col("rating").desc(), F.col(entity)], "rank")


def diagnostics_overlay(team_rows: DataFrame, fields: list[str], key: str = "game_id") -> DataFrame:
    """Both teams' diagnostic counters per game and whether they are complete."""
    def side(home: bool) -> list[Column]:
        flag = F.col("is_home") if home else ~F.col("is_home")
        return [F.max(F.when(flag, F.col(f))).alias(f"{'home' if home else 'away'}_{f}") for f in fields]

    known = F.count_if(F.greatest(*[F.col(f).isNull().cast("int") for f in fields]) == 0)
    both = (F.count_if(F.col("is_home")) == 1) & (F.count_if(~F.col("is_home")) == 1)
    return team_rows.groupBy(key).agg(
        *side(True), *side(False),
        F.when(both & (known == 2), F.lit("COMPLETE_UNWEIGHTED")).otherwise(F.lit("INCOMPLETE_UNWEIGHTED")).alias("injury_data_status"),
    )


def prediction_status(contract_reason: Column, valid: Column, kickoff: str, snapshot: str, cutoff: Column, feature_error: Column, earliest: float, latest: float, eligible: str) -> Column:
    """Eligibility ladder of a prediction row; the first failing rule names it."""
    minutes = minutes_between(kickoff, snapshot)
    ladder = first_reason(
        (F.col(kickoff) <= cutoff, "INELIGIBLE_BEFORE_PROSPECTIVE_CUTOFF"),
        (feature_error, "INELIGIBLE_FEATURES"),
        (minutes > earliest, "DIAGNOSTIC_EARLY_SNAPSHOT"),
        (minutes < latest, "INELIGIBLE_TOO_CLOSE_TO_KICKOFF"),
        otherwise=eligible,
    )
    return F.when(~valid, F.concat(F.lit("INELIGIBLE_"), F.coalesce(contract_reason, F.lit("ANCHOR_CONTRACT")))).otherwise(ladder)
