"""Probability calibration: logistic fits of all groups together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import CALIBRATOR_C, CALIBRATOR_CLIP
from asofspark.functions.scalars import clip, logistic, logit
from asofspark.session import checkpointed

MAX_STEPS = 40
"""Newton steps; a fit is done far earlier, when no group moves any more."""
MAX_MOVE = 4.0
"""Longest move of a coefficient in one step."""


def fit_by_group(df: DataFrame, group: str, probability: str, outcome: str, eps: float = CALIBRATOR_CLIP) -> DataFrame:
    """Intercept and slope of outcome on logit(probability), one row per group; any number of groups.

    Equal (group, probability, outcome) triples are merged into weights once.
    Every Newton step is one grouped sum over them for all groups together; only
    the longest move reaches the driver. The slope has the penalty 1 / (2 C). A
    group with one class has no slope; its constant rate is returned instead.
    """
    pairs = checkpointed(
        df.select(F.col(group).alias("_g"), logit(probability, eps).alias("_x"), F.col(outcome).cast("double").alias("_y"))
        .dropna(subset=["_x", "_y"])
        .groupBy("_g", "_x", "_y")
        .agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )
    groups = df.select(F.col(group).alias("_g")).distinct()
    totals = pairs.groupBy("_g").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("pos"))
    live = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    fits = checkpointed(totals.filter(live).select("_g", F.ln(F.col("pos") / (F.col("n") - F.col("pos"))).alias("_a"), F.lit(0.0).alias("_b")))
    for _ in range(MAX_STEPS):
        fits = checkpointed(_newton_step(pairs, fits))
        moved = fits.agg(F.max("_moved")).first()[0]
        if moved is None or moved < 1e-12:
            break
        fits = fits.drop("_moved")
    out = (
        groups.join(totals.withColumnRenamed("_g", "_t"), F.col("_g").eqNullSafe(F.col("_t")), "left")
        .join(fits.select(F.col("_g").alias("_f"), "_a", "_b"), F.col("_g").eqNullSafe(F.col("_f")), "left")
    )
    constant = F.when(F.col("_a").isNull() & (F.col("n") > 0), F.col("pos") / F.col("n"))
    return out.select(
        F.col("_g").alias(group), F.col("_a").alias("intercept"), F.col("_b").alias("slope"), constant.alias("constant"),
        F.coalesce("n", F.lit(0.0)).cast("bigint").alias("rows"),
    )


def _newton_step(pairs: DataFrame, fits: DataFrame) -> DataFrame:
    p = logistic(F.col("_a") + F.col("_b") * F.col("_x"))
    rows = pairs.join(fits.withColumnRenamed("_g", "_f"), F.col("_g").eqNullSafe(F.col("_f"))).select("_g", "_a", "_b", "_x", "_y", "_w", p.alias("_p"))
    gap, bend = F.col("_w") * (F.col("_p") - F.col("_y")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
    sums = rows.groupBy("_g", "_a", "_b").agg(
        F.sum(gap).alias("g0"), F.sum(gap * F.col("_x")).alias("g1"),
        F.sum(bend).alias("h00"), F.sum(bend * F.col("_x")).alias("h01"), F.sum(bend * F.col("_x") * F.col("_x")).alias("h11"),
    )
    ridge = 1.0 / CALIBRATOR_C
    g1, h11 = F.col("g1") + ridge * F.col("_b"), F.col("h11") + ridge
    det = F.col("h00") * h11 - F.col("h01") * F.col("h01")
    da = F.try_divide(h11 * F.col("g0") - F.col("h01") * g1, det)
    db = F.try_divide(F.col("h00") * g1 - F.col("h01") * F.col("g0"), det)
    longest = F.greatest(F.abs(da), F.abs(db), F.lit(1e-300))
    scale = F.least(F.lit(1.0), F.lit(MAX_MOVE) / longest)
    step = lambda d: F.coalesce(d * scale, F.lit(0.0))
    return sums.select(
        "_g", (F.col("_a") - step(da)).alias("_a"), (F.col("_b") - step(db)).alias("_b"), F.greatest(F.abs(step(da)), F.abs(step(db))).alias("_moved")
    )


def calibrated(probability: str | Column, intercept: str = "intercept", slope: str = "slope", constant: str = "constant") -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    fitted = logistic(F.col(intercept) + F.col(slope) * logit(p, CALIBRATOR_CLIP))
    return F.when(p.isNotNull(), F.coalesce(fitted, F.col(constant)))


def contract_probability(weight: Column, model: Column, market: Column) -> Column:
    """The market's own probability where the model has no weight, clipped."""
    p = F.when((weight == 0.0) & market.isNotNull(), market).otherwise(model)
    return clip(p, 1e-8, 1.0 - 1e-8)
