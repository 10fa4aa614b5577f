"""Walk-forward ridge regression from distributed moments.

One pass turns the rows into a small block per (market, configuration, season):
row count, means and centred products, which combine pairwise without
cancellation, however far the means lie from zero. Combined over the seasons
before it, the blocks are the training data of every fold; each fold, penalty
and feature subset is a tiny solve on its block. The rows are read a second time
only to score them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.fixed_values import RIDGE_GRID

BLOCK = "block"
"""Array column: count, means, and the upper triangle of the centred products."""
SALTS = 32


class Moments:
    """Count, means and centred products of some columns."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        z = x - mean
        return cls(float(len(x)), mean, z.T @ z)

    @classmethod
    def unpacked(cls, block) -> Moments:
        block = np.asarray(block, float)
        size = int((np.sqrt(9 + 8 * (len(block) - 1)) - 3) / 2 + 0.5)
        products = np.zeros((size, size))
        products[np.triu_indices(size)] = block[1 + size :]
        return cls(block[0], block[1 : 1 + size], products + np.triu(products, 1).T)

    def packed(self) -> list[float]:
        return [self.n, *self.mean.tolist(), *self.products[np.triu_indices(len(self.mean))].tolist()]

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        products = self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), products)

    def of_forms(self, a: np.ndarray, a0: float, b: np.ndarray, b0: float) -> float:
        """Sum over the rows of (a0 + a·x) (b0 + b·x)."""
        return float(self.n * (a0 + a @ self.mean) * (b0 + b @ self.mean) + a @ self.products @ b)

    def transformed(self, t: np.ndarray) -> Moments:
        return Moments(self.n, t @ self.mean, t @ self.products @ t.T)


def _block_schema(df: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *more, T.StructField(BLOCK, T.ArrayType(T.DoubleType()))])


def merged_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One block per key. Blocks of a key meet in two steps, so a key that every task has seen is folded by many tasks first."""
    schema = _block_schema(blocks, keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(pdf[BLOCK].map(tuple))  # one order of addition
        total = Moments.unpacked(parts[0])
        for part in parts[1:]:
            total = total + Moments.unpacked(part)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), total.packed()]], columns=[*keys, BLOCK])

    salted = blocks.withColumn("_salt", F.pmod(F.xxhash64(BLOCK), F.lit(SALTS)))
    return salted.groupBy(*keys, "_salt").applyInPandas(fold, schema).groupBy(*keys).applyInPandas(fold, schema)


def gram_blocks(df: DataFrame, keys: list[str], features: list[str], target: str = "target", line: str = "line") -> DataFrame:
    """A block of (features, target, line) per key.

    Each task folds its rows into one block per key, so the shuffle carries
    blocks, not rows. Keys are few: markets x configurations x seasons.
    """
    cols = [*features, target, line]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[tuple, Moments] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                new = Moments.of(part[cols].to_numpy(dtype=float))
                blocks[key] = blocks[key] + new if key in blocks else new
        if blocks:
            yield pd.DataFrame([(*k, m.packed()) for k, m in blocks.items()], columns=[*keys, BLOCK])

    partial = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(fold, _block_schema(df, keys))
    return merged_blocks(partial, keys)


def training_blocks(blocks: DataFrame, keys: list[str], season: str = "season") -> DataFrame:
    """The combined block of all earlier seasons, for each season present but the first."""
    rest = [k for k in keys if k != season]

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(season)
        total, rows = None, []
        for _, r in pdf.iterrows():
            if total is not None:
                rows.append([*(r[k] for k in keys), total.packed()])
            here = Moments.unpacked(r[BLOCK])
            total = here if total is None else total + here
        return pd.DataFrame(rows, columns=[*keys, BLOCK])

    return blocks.select(*keys, BLOCK).groupBy(*rest).applyInPandas(prefix, _block_schema(blocks, keys))


def ridge_from_block(m: Moments, columns: list[int], alpha: float, target: int = -2) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of standardised ridge on a subset of columns."""
    idx = np.asarray(columns)
    cov = m.products[np.ix_(idx, idx)]
    var, mean, eps = np.diag(cov) / m.n, m.mean[idx], np.finfo(float).eps
    flat = var <= m.n * eps * var + (m.n * mean * eps) ** 2  # no more than rounding
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    a = cov / np.outer(scale, scale) + alpha * np.eye(len(idx))
    coef = np.linalg.solve(a, m.products[idx, target] / scale) / scale
    return float(m.mean[target] - coef @ mean), coef


def clipped_weight(num: float, den: float) -> float:
    return 0.0 if den <= 1e-12 else float(min(1.0, max(0.0, num / den)))


def solve_folds(
    train: DataFrame,
    keys: list[str],
    features: list[str],
    alphas: tuple[float, ...] = RIDGE_GRID,
    feature_sets: dict[str, list[str]] | None = None,
    min_train: int = 100,
    residual_target: bool = False,
) -> DataFrame:
    """One coefficient row per (keys, feature set, alpha).

    ``coef`` has one entry per feature (zero outside the subset). With
    ``residual_target`` the regression explains target - line. The market
    weight of the fold's own training projections comes from the same block.
    """
    sets = feature_sets or {"all": features}
    size = len(features) + 2
    position = {f: i for i, f in enumerate(features)}
    made = T.StructType.fromDDL(
        "feature_set string, n_features int, alpha double, n_train bigint, intercept double, coef array<double>, scaled_coef array<double>, train_weight double"
    )
    schema = T.StructType([*(train.schema[k] for k in keys), *made.fields])
    names = schema.names

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = Moments.unpacked(getattr(r, BLOCK))
                if round(m.n) < min_train:
                    continue
                key = [getattr(r, k) for k in keys]
                y, line = size - 2, size - 1
                gap = np.zeros(size)
                gap[y], gap[line] = 1.0, -1.0
                h = m
                if residual_target:
                    t = np.eye(size)
                    t[y, line] = -1.0  # the target becomes target - line
                    h = m.transformed(t)
                sd = np.sqrt(np.maximum(np.diag(m.products)[: size - 2] / m.n, 0.0))
                for name, subset in sets.items():
                    idx = [position[f] for f in subset]
                    for alpha in alphas:
                        intercept, b = ridge_from_block(h, idx, alpha)
                        delta = np.zeros(size)
                        delta[idx] = b
                        coef = delta[: size - 2].copy()
                        if not residual_target:
                            delta[line] = -1.0
                        weight = clipped_weight(m.of_forms(delta, intercept, gap, 0.0), m.of_forms(delta, intercept, delta, intercept))
                        rows.append((*key, name, len(idx), float(alpha), int(round(m.n)), intercept, coef.tolist(), (coef * sd).tolist(), weight))
            yield pd.DataFrame(rows, columns=names)

    return train.select(*keys, BLOCK).mapInPandas(solve, schema)


def projection(features: list[str], intercept: str = "intercept", coef: str = "coef"):
    """Dot product of the feature columns with a coefficient array column."""
    total = F.col(intercept)
    for i, f in enumerate(features):
        total = total + F.col(coef)[i] * F.col(f)
    return total


def out_of_fold(
    rows: DataFrame,
    keys: list[str],
    features: list[str],
    alphas: tuple[float, ...] = RIDGE_GRID,
    feature_sets: dict[str, list[str]] | None = None,
    min_train: int = 100,
    residual_target: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold rows, coefficient table) of the whole grid.

    ``keys`` ends in the season; a row of season s is scored by the model of
    the seasons before s. The coefficient table is bounded by the grid, not by
    the data, so Catalyst will broadcast it.
    """
    train = training_blocks(gram_blocks(rows, keys, features), keys, keys[-1])
    coefs = solve_folds(train, keys, features, alphas, feature_sets, min_train, residual_target)
    scored = rows.join(coefs, keys).withColumn("raw", projection(features))
    drop = [*features, "intercept", "coef", "scaled_coef"]
    return scored.drop(*drop), coefs


def coefficient_table(coefs: DataFrame, features: list[str]) -> DataFrame:
    """Standardised coefficients in long form."""
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("scaled_coef").alias("value"))
    rest = [c for c in coefs.columns if c not in ("coef", "scaled_coef", "intercept", "train_weight")]
    return coefs.select(*rest, F.explode(named).alias("_c")).select(
        *rest, F.col("_c.feature").alias("feature"), F.col("_c.value").alias("standardized_coefficient")
    )


def market_weight(delta, residual):
    """clip(Σ δ·r / Σ δ², 0, 1) as an aggregate; 0 when δ vanishes."""
    num, den = F.sum(delta * residual), F.sum(delta * delta)
    return F.when(den <= 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den)))


def blend_projection(raw, line, weight):
    return weight * raw + (F.lit(1.0) - weight) * line


def season_stats(oof: DataFrame, keys: list[str], residual_target: bool = False) -> DataFrame:
    """Per-season sums from which every selection score follows."""
    r = F.col("target") - F.col("line")
    d = F.col("raw") if residual_target else F.col("raw") - F.col("line")
    e = F.col("target") - F.col("raw")
    return oof.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("see"),
        F.sum("target").alias("sy"),
        F.sum(F.col("target") * F.col("target")).alias("syy"),
        F.sum(d * d).alias("sdd"),
        F.sum(d * r).alias("sdr"),
        F.sum(r * r).alias("srr"),
    )


def select_configuration(
    stats: DataFrame,
    config: list[str],
    by_adjusted: bool = False,
    min_rows: int = 100,
    season: str = "season",
) -> DataFrame:
    """The configuration and penalties chosen for every outer season at once.

    For season s only out-of-fold rows of earlier seasons count; the row with
    a null season is the final choice from all of them. The penalty of each
    market minimises RMSE (after the market weight if ``by_adjusted``); the
    configuration minimises the mean of RMSE / sample sd over the markets,
    then the configuration columns in order.
    """
    cols = ["n", "see", "sy", "syy", "sdd", "sdr", "srr"]
    keys = ["market", *config, "alpha"]
    w = Window.partitionBy(*keys).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    before = stats.select(*keys, season, *[F.sum(c).over(w).alias(c) for c in cols])
    final = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]).withColumn(season, F.lit(None).cast("int"))
    pool = before.unionByName(final).filter(F.col("n") >= min_rows)
    weight = F.when(F.col("sdd") <= 1e-12, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sdr") / F.col("sdd")))
    )
    pool = pool.withColumn("market_weight", weight)
    adjusted = F.col("srr") - 2 * F.col("market_weight") * F.col("sdr") + F.pow("market_weight", F.lit(2)) * F.col("sdd")
    sse = adjusted if by_adjusted else F.col("see")
    sd = F.sqrt(F.greatest(F.try_divide(F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("n") - 1), F.lit(0.0)))
    scored = pool.withColumn("rmse", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n"))).withColumn(
        "normalized", F.col("rmse") / F.greatest(sd, F.lit(1e-9))
    )
    pick = F.struct("rmse", "alpha", "normalized", "market_weight", "n")
    ridge = scored.groupBy(season, "market", *config).agg(F.min_by(pick, F.struct("rmse", "alpha")).alias("r"))
    combos = ridge.groupBy(season, *config).agg(
        F.avg("r.normalized").alias("score"),
        F.count(F.lit(1)).alias("_m"),
        F.max(F.when(F.col("market") == "spreads", F.col("r"))).alias("spreads"),
        F.max(F.when(F.col("market") == "totals", F.col("r"))).alias("totals"),
    ).filter("_m = 2")
    best = combos.groupBy(season).agg(
        F.min_by(F.struct(*config, "score", "spreads", "totals"), F.struct("score", *config)).alias("b")
    )
    rows = best.select(season, "b.*").select(
        season, *config, "score",
        F.inline(F.array(
            F.struct(F.lit("spreads").alias("market"), *[F.col(f"spreads.{c}").alias(c) for c in ("alpha", "rmse", "market_weight", "n")]),
            F.struct(F.lit("totals").alias("market"), *[F.col(f"totals.{c}").alias(c) for c in ("alpha", "rmse", "market_weight", "n")]),
        )),
    )
    return rows.withColumnRenamed("n", "inner_rows")


def nested_predictions(oof: DataFrame, selection: DataFrame, config: list[str], residual_target: bool = False) -> DataFrame:
    """Outer-fold predictions: the chosen model of season s applied to season s.

    The model fitted on seasons before s is already the out-of-fold model of
    s, so the outer evaluation is a join of the two tables.
    """
    keys = ["season", "market", *config, "alpha"]
    chosen = selection.filter(F.col("season").isNotNull()).select(*keys, "market_weight")
    w = F.col("market_weight")
    final = F.col("line") + w * F.col("raw") if residual_target else blend_projection(F.col("raw"), F.col("line"), w)
    return oof.join(chosen, keys).withColumn("final", final)
