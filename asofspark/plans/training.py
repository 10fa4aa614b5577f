"""Training: matrix to selected configuration, coefficients and distributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import RIDGE_GRID
from asofspark.operators import calibrate as cal
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators import regression as rg
from asofspark.operators.matchup import CONFIG
from asofspark.session import checkpointed

KEYS = ["market", *CONFIG, "season"]
STATS = ["market", *CONFIG, "alpha", "season"]


@dataclass
class Trained:
    """A fitted model as small tables."""

    oof: DataFrame
    selection: DataFrame
    coefs: DataFrame
    residuals: ds.ResidualModel
    calibration: DataFrame
    priced: DataFrame


def walk_forward(rows: DataFrame, features: list[str], alphas=RIDGE_GRID, residual_target: bool = False, min_train: int = 100) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold rows written once, configuration choices per outer season)."""
    oof, _ = rg.out_of_fold(rows, KEYS, features, alphas, min_train=min_train, residual_target=residual_target)
    oof = checkpointed(oof)
    choice = rg.select_configuration(
        rg.season_stats(oof, STATS, residual_target), CONFIG, by_adjusted=residual_target, min_rows=min_train
    )
    return oof, choice


def final_rows(oof: DataFrame, choice: DataFrame, residual_target: bool = False) -> DataFrame:
    """Out-of-fold rows of the finally chosen configuration with their blended projection."""
    chosen = choice.filter(F.col("season").isNull()).select("market", *CONFIG, "alpha", "market_weight")
    w = F.col("market_weight")
    final = F.col("line") + w * F.col("raw") if residual_target else rg.blend_projection(F.col("raw"), F.col("line"), w)
    return oof.join(chosen, ["market", *CONFIG, "alpha"]).withColumn("final", final)


def final_coefficients(rows: DataFrame, choice: DataFrame, features: list[str], residual_target: bool = False) -> DataFrame:
    """Coefficients of the chosen configuration fitted on every season."""
    chosen = choice.filter(F.col("season").isNull()).select("market", *CONFIG, "alpha", F.col("market_weight").alias("weight"))
    keys = ["market", *CONFIG]
    blocks = rg.gram_blocks(rows.join(chosen.select(*keys), keys, "left_semi"), KEYS, features)
    whole = rg.merged_blocks(blocks, keys)
    coefs = rg.solve_folds(whole, keys, features, residual_target=residual_target)
    return coefs.join(chosen, [*keys, "alpha"]).select("market", *CONFIG, "alpha", "intercept", "coef", "weight")


def train(rows: DataFrame, features: list[str], residual_target: bool = False) -> Trained:
    """The whole development fit; ``rows`` is the per-market matrix of the grid."""
    oof, choice = walk_forward(rows, features, residual_target=residual_target)
    choice = checkpointed(choice)
    picked = checkpointed(final_rows(oof, choice, residual_target))
    residuals = ds.fit_distribution(picked, ["market"])
    priced = checkpointed(
        ds.score_distribution(residuals, picked, ["game_id"]).withColumn("p_model", ds.non_push())
    )
    live = priced.filter(ev.not_push("target", "line")).withColumn("outcome", (F.col("target") > F.col("line")).cast("double"))
    calibration = cal.fit_by_group(live, "market", "p_model", "outcome")
    return Trained(oof, choice, final_coefficients(rows, choice, features, residual_target), residuals, calibration, priced)


def nested_report(oof: DataFrame, choice: DataFrame, residual_target: bool = False) -> DataFrame:
    """Outer-season projections with distributions fitted on earlier seasons only.

    The inner rows of outer season s are those of earlier seasons under the
    configuration chosen for s; every outer season is one set of the same
    residual model, so there is no loop over folds.
    """
    outer = rg.nested_predictions(oof, choice, CONFIG, residual_target)
    chosen = choice.filter(F.col("season").isNotNull()).select(
        F.col("season").alias("outer_season"), "market", *CONFIG, "alpha", F.col("market_weight").alias("_w")
    )
    inner = oof.join(chosen, ["market", *CONFIG, "alpha"]).filter(F.col("season") < F.col("outer_season"))
    w = F.col("_w")
    blended = F.col("line") + w * F.col("raw") if residual_target else rg.blend_projection(F.col("raw"), F.col("line"), w)
    model = ds.fit_distribution(inner.withColumn("final", blended), ["outer_season", "market"])
    rows = outer.withColumn("outer_season", F.col("season"))
    return ds.score_distribution(model, rows, ["game_id"]).withColumn("probability", ds.non_push())
