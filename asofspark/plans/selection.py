"""Joint choice of configuration, feature set and penalty by log-loss."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.fixed_values import PROBABILITY_CLIP, RIDGE_GRID
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators import regression as rg
from asofspark.operators import trees as tr
from asofspark.operators.matchup import CONFIG
from asofspark.session import checkpointed

KEYS = ["market", *CONFIG, "season"]
CANDIDATE = ["market", *CONFIG, "feature_set", "alpha"]
ROWS_A_TASK = 500_000
"""Rows of a (market, configuration) that one task scores under all candidates."""
FAMILY_ORDER = {"market_only": -1, "ridge": 0, "tree": 1, "blend_25": 2, "blend_50": 3, "blend_75": 4}


def feature_set_grid(families: dict[str, list[str]], core: list[str], optional: list[str]) -> dict[str, list[str]]:
    """Core families with every combination of the optional ones."""
    out = {}
    for size in range(len(optional) + 1):
        for extra in combinations(optional, size):
            names = [*core, *extra]
            out["+".join(names)] = [c for n in names for c in families[n]]
    return out


def candidate_folds(rows: DataFrame, features: list[str], sets: dict[str, list[str]], alphas=RIDGE_GRID, min_train: int = 30) -> DataFrame:
    """Coefficients of every (configuration, feature set, penalty, fold).

    All feature sets share one row population, so each is a sub-block of the
    same Gram block.
    """
    train = rg.training_blocks(rg.gram_blocks(rows, KEYS, features), KEYS)
    return rg.solve_folds(train, KEYS, features, alphas, sets, min_train)


def candidate_probabilities(rows: DataFrame, features: list[str], coefs: DataFrame) -> DataFrame:
    """Out-of-fold probability of every row under every candidate.

    Each fold's market weight and residual distribution come from the fold's
    own training projections. This is the expensive step: rows x candidates x
    folds; it is a join on (market, configuration) with the small coefficient
    table and one distributed scan. A candidate's fold is one number in all
    that is grouped and shuffled; its columns are joined again at the end.
    """
    fold = coefs.withColumnRenamed("season", "fold").select(
        *CANDIDATE, "fold", "n_features", "intercept", "coef", "train_weight"
    )
    fold = checkpointed(fold.withColumn("_set", F.monotonically_increasing_id()))
    both = rows.join(F.broadcast(fold), ["market", *CONFIG]).filter(F.col("season") <= F.col("fold"))
    scored = both.withColumn("raw", rg.projection(features)).withColumn(
        "final", F.col("line") + F.col("train_weight") * (F.col("raw") - F.col("line"))
    ).select("game_id", "_set", "market", "fold", "season", "target", "line", "market_probability", "raw", "final")
    scored = checkpointed(scored)
    model = ds.fit_distribution(scored.filter("season < fold"), ["_set"])
    valid = ds.score_distribution(model, scored.filter("season = fold"), ["game_id"]).drop("market", "fold")
    named = fold.select("_set", *CANDIDATE, "fold", "n_features")
    return valid.join(F.broadcast(named), "_set").drop("_set").withColumns(
        {"probability": ds.non_push(), "outcome": (F.col("target") > F.col("line")).cast("double")}
    )


def candidate_scores(oof: DataFrame) -> DataFrame:
    return ev.probability_bundle(oof, [*CANDIDATE, "n_features"], "probability", "outcome", "target", "final", "line")


def grid_scores(rows: DataFrame, features: list[str], coefs: DataFrame, rows_a_task: int = ROWS_A_TASK, minimum: int = 30) -> DataFrame:
    """:func:`candidate_scores` of the whole grid; ``rows`` have no missing values.

    A task holds the rows of one (market, configuration) and scores them under all
    its candidates and folds, so rows are shuffled once, whatever the number of
    candidates, and one row of sums a candidate comes out. Where a (market,
    configuration) has more than ``rows_a_task`` rows, all go through the
    distributed scan of :func:`candidate_probabilities`. Sums are taken in the order
    of season and game, so candidates that say the same tie exactly.
    """
    keys = ["market", *CONFIG]
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if largest is not None and largest > rows_a_task:
        return candidate_scores(candidate_probabilities(rows, features, coefs))
    made = T.StructType.fromDDL(
        "feature_set string, alpha double, n_features int, rows bigint, non_push_rows bigint, log_loss double, brier double, rmse double"
    )
    schema = T.StructType([*(rows.schema[k] for k in keys), *made.fields])

    def score(held: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if held.empty or fits.empty:
            return pd.DataFrame(columns=schema.names)
        held = held.sort_values(["season", "game_id"], ignore_index=True)
        season, target, line = held["season"].to_numpy(), held["target"].to_numpy(float), held["line"].to_numpy(float)
        x = [held[f].to_numpy(float) for f in features]
        sums: dict[tuple, np.ndarray] = {}
        for fold, models in fits.groupby("season"):
            start, end = np.searchsorted(season, fold, "left"), np.searchsorted(season, fold, "right")
            actual, asked = target[start:end], line[start:end]
            live, outcome = np.abs(actual - asked) > 1e-9, (actual > asked).astype(float)
            past = ds.HeldResiduals(target[:start], line[:start], asked, held["market"].iloc[0] == "spreads")
            for m in models.itertuples(index=False):
                raw = np.full(end, m.intercept)
                for c, v in zip(m.coef, x, strict=True):
                    raw = raw + c * v[:end]
                final = line[:end] + m.train_weight * (raw - line[:end])
                win, _, loss = past.probabilities(target[:start] - final[:start], asked - final[start:])
                with np.errstate(invalid="ignore", divide="ignore"):
                    p = np.clip(win / (win + loss), PROBABILITY_CLIP, 1.0 - PROBABILITY_CLIP)
                told = live & ~np.isnan(p)
                q, y, e = p[told], outcome[told], actual - final[start:]
                missed = -(y * np.log(q) + (1.0 - y) * np.log(1.0 - q))
                new = np.array([end - start, live.sum(), told.sum(), missed.sum(), ((q - y) ** 2).sum(), (e * e).sum()])
                name = (m.feature_set, m.alpha, m.n_features)
                sums[name] = sums[name] + new if name in sums else new
        out = []
        for name, (n, lively, known, missed, squared, error) in sums.items():
            enough = lively >= minimum and known > 0
            scores = (missed / known, squared / known) if enough else (None, None)
            out.append((*(held[k].iloc[0] for k in keys), *name, int(n), int(lively), *scores, (error / n) ** 0.5))
        return pd.DataFrame(out, columns=schema.names)

    kept = rows.select(*keys, "season", "game_id", *[F.col(c).cast("double").alias(c) for c in ("target", "line", *features)])
    fits = coefs.select(*CANDIDATE, "season", "n_features", "intercept", "coef", "train_weight")
    return kept.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInPandas(score, schema)


def best_candidates(scores: DataFrame) -> DataFrame:
    """Per market: log-loss, then Brier, RMSE, fewer features, configuration, name, penalty."""
    order = F.struct("log_loss", "brier", "rmse", "n_features", *CONFIG, "feature_set", "alpha")
    rest = [c for c in scores.columns if c != "market"]
    kept = scores.filter(F.col("log_loss").isNotNull())
    return kept.groupBy("market").agg(F.min_by(F.struct(*rest), order).alias("b")).select("market", "b.*")


def family_probabilities(rows: DataFrame, features: list[str], chosen: DataFrame, sets: dict[str, list[str]], min_train: int = 30, settings: tr.Boosting = tr.Boosting()) -> DataFrame:
    """Out-of-fold probabilities of ridge, trees and their blends under the chosen candidate of every market.

    ``chosen`` has one row a market (two in all). All folds of a market's trees grow in one job; every fold's
    market weight and residuals come from its own training projections, of all families at once.
    """
    parts = []
    for c in chosen.select(*CANDIDATE).collect():
        same = rows.filter(F.col("market") == c["market"])
        for k in CONFIG:
            same = same.filter(F.col(k) == c[k])
        same = checkpointed(same)
        names = sets[c["feature_set"]]
        coefs = candidate_folds(same, features, {c["feature_set"]: names}, (c["alpha"],), min_train)
        ridge = coefs.select("market", F.col("season").alias("fold"), "intercept", "coef")
        folds = [r[0] for r in same.select("season").distinct().collect()]
        trees = tr.boost_folds(same, ["market"], names, folds, min_train=min_train, settings=settings).withColumnRenamed("season", "fold")
        both = same.join(ridge, "market").filter(F.col("season") <= F.col("fold")).withColumn("ridge", rg.projection(features))
        both = tr.score_trees(both, trees, ["market", "fold"], names, "tree")
        families = F.array(*[F.struct(F.lit(f).alias("family"), tr.blend("ridge", "tree", f).alias("raw")) for f in tr.BLENDS])
        parts.append(both.select("game_id", "market", "season", "fold", "target", "line", "market_probability", F.inline(families)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = checkpointed(every)
    gap = F.col("raw") - F.col("line")
    weights = every.filter("season < fold").groupBy("market", "family", "fold").agg(rg.market_weight(gap, F.col("target") - F.col("line")).alias("weight"))
    scored = checkpointed(every.join(weights, ["market", "family", "fold"]).withColumn("final", F.col("line") + F.col("weight") * gap))
    model = ds.fit_distribution(scored.filter("season < fold"), ["market", "family", "fold"])
    return ds.score_distribution(model, scored.filter("season = fold"), ["game_id"]).withColumns(
        {"probability": ds.non_push(), "outcome": (F.col("target") > F.col("line")).cast("double")}
    )


def market_only_scores(oof: DataFrame) -> DataFrame:
    """The market's own probability scored on the same rows."""
    return oof.groupBy("market").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(ev.not_push("target", "line", 1e-9), ev.log_loss("market_probability", "outcome"))).alias("log_loss"),
        F.avg(F.when(ev.not_push("target", "line", 1e-9), ev.brier("market_probability", "outcome", clip=False))).alias("brier"),
        ev.rmse("target", "line").alias("rmse"),
    )


def choose_family(scores: DataFrame) -> DataFrame:
    """Best model family per market; the market alone wins ties.

    scores: market, family, log_loss, brier, rmse.
    """
    ranks = F.create_map(*[F.lit(x) for kv in FAMILY_ORDER.items() for x in kv])
    ranked = scores.withColumn("_o", ranks[F.col("family")])
    rest = [c for c in scores.columns if c != "market"]
    return ranked.groupBy("market").agg(
        F.min_by(F.struct(*rest), F.struct("log_loss", "brier", "rmse", "_o")).alias("b")
    ).select("market", "b.*")
