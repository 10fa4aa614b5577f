"""Strictly lagged features, season priors and their blend.

The lag store holds one row per entity and period, so a window over
(entity, season) is bounded by the number of periods in a season, whatever the
size of the fact table that was aggregated into it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.fixed_values import HALF_LIFE_GRID, LAG_COUNT, PRIOR_STRENGTH_GRID
from asofspark.operators import scan


def _listed(c: str | list[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def lag_name(k: int, metric: str) -> str:
    return f"lag{k}_{metric}"


def _available(metric: str, n: int) -> Column:
    return reduce(add, [F.col(lag_name(k, metric)).isNotNull().cast("int") for k in range(1, n + 1)])


def build_lags(
    rows: DataFrame,
    metrics: list[str],
    entity: str | list[str] = "team_id",
    season: str = "season",
    ts: str = "kickoff_dt",
    row_id: str = "game_id",
    n: int = LAG_COUNT,
    split: bool = False,
) -> DataFrame:
    """Explicit lags 1..n of every metric and of the time, within entity-season.

    ``games_available`` counts the non-null lags of the first metric. One row
    per period keeps an entity-season small; ``split`` is for inputs where one
    entity-season may hold a large share of all rows, and spreads it by time.
    """
    if split:
        keys = [*_listed(entity), season]
        lagged = scan.lags(rows, keys, [F.col(ts), F.col(row_id)], [ts, *metrics], n, lag_name)
        return lagged.withColumn("games_available", _available(metrics[0], n))
    w = Window.partitionBy(*_listed(entity), season).orderBy(ts, row_id)
    lags = {
        lag_name(k, c): F.lag(c, k).over(w)
        for k in range(1, n + 1)
        for c in [ts, *metrics]
    }
    return rows.withColumns(lags).withColumn("games_available", _available(metrics[0], n))


def decay_weights(half_life: float, n: int = LAG_COUNT) -> list[Column]:
    """Literal weights 2^(-offset / half-life) for offsets 0..n-1."""
    return [F.lit(2.0 ** (-k / half_life)) for k in range(n)]


def half_life_rows(df: DataFrame, half_lives: list[float], n: int = LAG_COUNT) -> DataFrame:
    """Every row under every half-life, with its weights as columns ``_w0``.."""
    choices = [
        F.struct(F.lit(float(h)).alias("half_life"), *[w.alias(f"_w{k}") for k, w in enumerate(decay_weights(h, n))])
        for h in half_lives
    ]
    return df.select("*", F.inline(F.array(*choices)))


def decayed_mean(values: list[Column], weights: list[Column]) -> Column:
    """Σ w·x / Σ w over the non-null values; null when all are missing."""
    num = reduce(add, [F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights)])
    den = reduce(add, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights)])
    return F.try_divide(num, den)


def configurations(df: DataFrame, half_lives=HALF_LIFE_GRID, strengths=PRIOR_STRENGTH_GRID) -> DataFrame:
    """Every row under every (half-life, prior strength) of the grid, as rows."""
    grid = [
        F.struct(F.lit(float(h)).alias("half_life"), F.lit(float(s)).alias("prior_strength"))
        for h in half_lives
        for s in strengths
    ]
    return df.select("*", F.explode(F.array(*grid)).alias("_cfg")).select(
        *df.columns, "_cfg.half_life", "_cfg.prior_strength"
    )


def season_priors(
    lags: DataFrame,
    metrics: list[str],
    half_lives: list[float] | None,
    entity: str = "team_id",
    season: str = "season",
    ts: str = "kickoff_dt",
    row_id: str = "game_id",
    n: int = LAG_COUNT,
    within: list[str] | None = None,
) -> DataFrame:
    """End-of-season strength per entity and its league average, for the next season.

    Built from the last n rows whose first metric is observed, offset 0
    included. The league prior averages the entity priors of the season.
    With ``half_lives`` None the rows already carry a ``half_life`` column, and
    ``within`` names the configuration columns that keep their histories apart.
    """
    within = within or []
    recent = Window.partitionBy(entity, *within, season).orderBy(F.col(ts).desc(), F.col(row_id).desc())
    tail = (
        lags.filter(F.col(metrics[0]).isNotNull())
        .select(entity, *within, season, *metrics, (F.row_number().over(recent) - 1).alias("_k"))
        .filter(F.col("_k") < n)
    )
    if half_lives is None:
        tail = tail.withColumn("_w", F.pow(F.lit(2.0), -F.col("_k") / F.col("half_life")))
        group = [season, *within]
    else:
        tail = half_life_rows(tail, half_lives, n).withColumn(
            "_w", F.array(*[F.col(f"_w{k}") for k in range(n)])[F.col("_k")]
        )
        group = [season, *within, "half_life"]
    team = tail.groupBy(entity, *group).agg(
        *[
            F.try_divide(F.sum(F.col(m) * F.col("_w")), F.sum(F.when(F.col(m).isNotNull(), F.col("_w")))).alias(
                f"team_prior_{m}"
            )
            for m in metrics
        ]
    )
    average = team.groupBy(*group).agg(*[F.avg(f"team_prior_{m}").alias(f"league_prior_{m}") for m in metrics])
    return team.join(average, group).withColumn(season, F.col(season) + 1)


def blend(current: Column, team_prior: Column, league_prior: Column, strength: Column, available: Column, n: int = LAG_COUNT) -> Column:
    """Season-to-date value shrunk to the prior by the number of games seen."""
    prior = strength * team_prior + (F.lit(1.0) - strength) * league_prior
    share = F.least(available, F.lit(n)).cast("double") / n
    mixed = share * current + (F.lit(1.0) - share) * prior  # null when either part is
    return F.coalesce(mixed, current, prior)


def materialize(
    lags: DataFrame,
    metrics: list[str],
    half_lives: list[float] = HALF_LIFE_GRID,
    strengths: list[float] = PRIOR_STRENGTH_GRID,
    entity: str = "team_id",
    season: str = "season",
    ts: str = "kickoff_dt",
    row_id: str = "game_id",
    n: int = LAG_COUNT,
) -> DataFrame:
    """Weighted feature rows for each configuration of the grid.

    Configurations are rows (columns ``half_life`` and ``prior_strength``), so
    one plan covers the grid. Each metric column holds its blended value.
    """
    priors = season_priors(lags, metrics, list(half_lives), entity, season, ts, row_id, n)
    weights = [F.col(f"_w{k}") for k in range(n)]
    current = {
        f"_cur_{m}": decayed_mean([F.col(lag_name(k, m)) for k in range(1, n + 1)], weights) for m in metrics
    }
    # the decayed mean depends on the half-life alone: take it before the strengths fan out
    rows = half_life_rows(lags, half_lives, n).withColumns(current).drop(*[f"_w{k}" for k in range(n)])
    strength = F.explode(F.array(*[F.lit(float(s)) for s in strengths]))
    fanned = rows.join(priors, [entity, season, "half_life"], "left").withColumn("prior_strength", strength)
    blended = {
        m: blend(
            F.col(f"_cur_{m}"),
            F.col(f"team_prior_{m}"),
            F.col(f"league_prior_{m}"),
            F.col("prior_strength"),
            F.col("games_available"),
            n,
        )
        for m in metrics
    }
    drop = [c for m in metrics for c in (f"team_prior_{m}", f"league_prior_{m}", f"_cur_{m}")]
    return fanned.withColumns(blended).drop(*drop)


def opponent_gap(
    own: DataFrame,
    pregame: DataFrame,
    pairs: dict[str, tuple[str, str]],
    keys: list[str],
    entity: str = "team_id",
    opponent: str = "opponent_team_id",
) -> DataFrame:
    """Observed value minus what the opponent's pregame strength would give."""
    other = pregame.select(
        *keys,
        F.col(entity).alias(opponent),
        *[F.col(m).alias(f"_opp_{m}") for m in dict.fromkeys(m for pair in pairs.values() for m in pair)],
    )
    gaps = {}
    for name, (off, deff) in pairs.items():
        gaps[f"off_opp_adj_{name}"] = F.col(off) - F.col(f"_opp_{deff}")
        gaps[f"def_opp_adj_{name}"] = F.col(deff) - F.col(f"_opp_{off}")
    joined = own.join(other, [*keys, opponent], "left").withColumns(gaps)
    return joined.drop(*[f"_opp_{m}" for pair in pairs.values() for m in pair])


def opponent_adjusted(
    lags: DataFrame,
    pregame: DataFrame,
    pairs: dict[str, tuple[str, str]],
    half_lives: list[float] = HALF_LIFE_GRID,
    strengths: list[float] = PRIOR_STRENGTH_GRID,
    entity: str = "team_id",
    opponent: str = "opponent_team_id",
    season: str = "season",
    ts: str = "kickoff_dt",
    row_id: str = "game_id",
) -> DataFrame:
    """Own observed value minus the opponent's pregame strength, re-lagged and re-blended.

    ``pregame`` is the output of :func:`materialize` for the same grid;
    ``pairs`` maps a name to its (offense, defense) metric pair. Returns the
    adjusted metrics per (row_id, entity, half_life, prior_strength).
    """
    adjusted = [f"{side}_opp_adj_{name}" for name in pairs for side in ("off", "def")]
    metrics = list(dict.fromkeys(m for pair in pairs.values() for m in pair))
    own = configurations(lags.select(row_id, entity, opponent, season, ts, *metrics), half_lives, strengths)
    keys = [row_id, "half_life", "prior_strength"]
    observed = opponent_gap(own, pregame, pairs, keys, entity, opponent).select(
        row_id, entity, season, ts, "half_life", "prior_strength", *adjusted
    )
    # each configuration is its own history
    config = ["half_life", "prior_strength"]
    relagged = build_lags(observed, adjusted, [entity, *config], season, ts, row_id)
    priors = season_priors(relagged, adjusted, None, entity, season, ts, row_id, within=config)
    weights = F.array(*[F.pow(F.lit(2.0), F.lit(-float(k)) / F.col("half_life")) for k in range(LAG_COUNT)])
    joined = relagged.join(priors, [entity, *config, season], "left").withColumn("_w", weights)
    return joined.select(
        row_id,
        entity,
        "half_life",
        "prior_strength",
        *[
            blend(
                decayed_mean(
                    [F.col(lag_name(k, m)) for k in range(1, LAG_COUNT + 1)],
                    [F.col("_w")[k] for k in range(LAG_COUNT)],
                ),
                F.col(f"team_prior_{m}"),
                F.col(f"league_prior_{m}"),
                F.col("prior_strength"),
                F.col("games_available"),
            ).alias(m)
            for m in adjusted
        ],
    )


def sequence_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str = "game_number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def recency_index(rows: DataFrame, keys: list[str], order: list[str], name: str = "games_ago") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn(name, F.row_number().over(w) - 1)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, as an aggregate that folds map-side."""
    return _edge(rows, keys, order, F.min_by)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key (ties broken by the later order columns)."""
    return _edge(rows, keys, order, F.max_by)


def _edge(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    edge = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return edge.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)
