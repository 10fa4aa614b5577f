"""Registered queries: facts to lagged and blended features."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.catalog.bindings import GAMES_SQL, PLAYS_SQL, games, play_sums, plays, r6, rounded
from asofspark.operators import observe as obs
from asofspark.operators import schedule as sched
from asofspark.operators import temporal as tmp

BASE = obs.names(obs.BASE_METRICS)


def _means_sql(metrics: list[obs.Metric], side: str) -> str:
    """One column per metric; null on the side the metric does not describe."""
    return ", ".join(
        f"avg(CASE WHEN side = '{m.side}' AND {m.where} THEN {m.value} END) AS {m.name}" for m in metrics
    )


def observations_sql(metrics: list[obs.Metric], having: str = "") -> str:
    return f"""regular AS (SELECT * FROM plays WHERE season_type = 'REG' AND epa IS NOT NULL
  AND posteam IS NOT NULL AND defteam IS NOT NULL),
sides AS (SELECT 'off' AS side, posteam AS team_id, * FROM regular
  UNION ALL SELECT 'def' AS side, defteam AS team_id, * FROM regular),
observations AS (SELECT game_id, season, week, team_id, {_means_sql(metrics, '')}
  FROM sides GROUP BY game_id, season, week, team_id {having})"""


BASE_HAVING = (
    "HAVING count(CASE WHEN qb_dropback = 1 OR (rush_attempt = 1 AND coalesce(qb_kneel, 0) <> 1) THEN 1 END) > 0"
)


def _rounded_sql(keys: str, metrics: list[str], source: str) -> str:
    return f"SELECT {keys}, {', '.join(f'{r6(m)} AS {m}' for m in metrics)} FROM {source}"


def base_observations(spark, sf_dir):
    return rounded(obs.base_observations(plays(spark, sf_dir)))


def extended_observations(spark, sf_dir):
    return rounded(obs.extended_observations(plays(spark, sf_dir)))


def advanced_observations(spark, sf_dir):
    return rounded(obs.advanced_observations(plays(spark, sf_dir)))


def games_and_observations(spark, sf_dir, metrics=obs.BASE_METRICS):
    """(games, observations) from a single pass over the plays."""
    sums = play_sums(spark, sf_dir, metrics)
    return games(sums), obs.entity_means(sums, metrics)


def team_games(spark, sf_dir, metrics=obs.BASE_METRICS):
    """Two rows per regular game with that game's own observations, written once."""
    dim, observed = games_and_observations(spark, sf_dir, metrics)
    rows = sched.entity_rows(dim.filter("game_type = 'REG'"), ["game_id", "season", "week", "kickoff_dt"])
    return rows.join(observed, ["game_id", "season", "week", "team_id"], "left")


TEAM_GAMES_SQL = f"""{PLAYS_SQL},
{GAMES_SQL},
{observations_sql(obs.BASE_METRICS, BASE_HAVING)},
entity_rows AS (SELECT game_id, season, week, kickoff_dt, home_team AS team_id, away_team AS opponent_team_id, true AS is_home
    FROM games WHERE game_type = 'REG'
  UNION ALL SELECT game_id, season, week, kickoff_dt, away_team, home_team, false FROM games WHERE game_type = 'REG'),
team_games AS (SELECT r.*, {', '.join('o.' + m for m in BASE)} FROM entity_rows r
  LEFT JOIN observations o ON o.game_id = r.game_id AND o.season = r.season AND o.week = r.week AND o.team_id = r.team_id)"""

_LAGS = ", ".join(
    f"lag({c}, {k}) OVER w AS lag{k}_{c}" for k in range(1, 5) for c in ["kickoff_dt", *BASE]
)
LAGS_SQL = f"""{TEAM_GAMES_SQL},
lags0 AS (SELECT *, {_LAGS} FROM team_games
  WINDOW w AS (PARTITION BY team_id, season ORDER BY kickoff_dt, game_id)),
lags AS (SELECT *, {' + '.join(f'CASE WHEN lag{k}_{BASE[0]} IS NOT NULL THEN 1 ELSE 0 END' for k in range(1, 5))} AS games_available FROM lags0)"""


def lag_store(spark, sf_dir):
    return rounded(tmp.build_lags(team_games(spark, sf_dir), BASE))


def _decay_sql(metric: str, h: str) -> str:
    num = " + ".join(f"coalesce(lag{k}_{metric}, 0) * pow(2e0, -{k - 1} / {h})" for k in range(1, 5))
    den = " + ".join(f"CASE WHEN lag{k}_{metric} IS NULL THEN 0 ELSE pow(2e0, -{k - 1} / {h}) END" for k in range(1, 5))
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END)"


def decayed_features(spark, sf_dir):
    """Half-life weighted mean of the last four games, strictly before each game."""
    lags = tmp.build_lags(team_games(spark, sf_dir), BASE)
    weights = tmp.decay_weights(2.0)
    means = {m: tmp.decayed_mean([F.col(tmp.lag_name(k, m)) for k in range(1, 5)], weights) for m in BASE}
    return rounded(
        lags.select("game_id", "team_id", "season", "games_available", *[c.alias(m) for m, c in means.items()])
    )


def season_priors(spark, sf_dir):
    lags = tmp.build_lags(team_games(spark, sf_dir), BASE)
    return rounded(tmp.season_priors(lags, BASE, [1.0, 2.0, 4.0]))


PRIORS_SQL = f"""tail AS (SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY kickoff_dt DESC, game_id DESC) - 1 AS k
  FROM lags WHERE {BASE[0]} IS NOT NULL),
halves AS (SELECT * FROM (VALUES (1e0), (2e0), (4e0)) t(half_life)),
team_prior AS (SELECT team_id, season, half_life, {', '.join(
    f"CASE WHEN sum(CASE WHEN {m} IS NOT NULL THEN 1 END) > 0 THEN sum({m} * pow(2e0, -k / half_life)) / sum(CASE WHEN {m} IS NOT NULL THEN pow(2e0, -k / half_life) END) END AS team_prior_{m}" for m in BASE)}
  FROM tail CROSS JOIN halves WHERE k < 4 GROUP BY team_id, season, half_life),
league_prior AS (SELECT season, half_life, {', '.join(f'avg(team_prior_{m}) AS league_prior_{m}' for m in BASE)}
  FROM team_prior GROUP BY season, half_life),
priors AS (SELECT team_id, t.season + 1 AS season, t.half_life, {', '.join(f'team_prior_{m}, league_prior_{m}' for m in BASE)}
  FROM team_prior t JOIN league_prior l ON l.season = t.season AND l.half_life = t.half_life)"""


def blended_features(spark, sf_dir):
    """Flagship: the full configuration grid of leakage-safe features."""
    lags = tmp.build_lags(team_games(spark, sf_dir), BASE)
    grid = tmp.materialize(lags, BASE)
    return rounded(
        grid.select("game_id", "team_id", "season", "half_life", "prior_strength", "games_available", *BASE)
    )


def _blend_sql(m: str) -> str:
    cur = _decay_sql(m, "half_life")
    prior = f"(prior_strength * team_prior_{m} + (1 - prior_strength) * league_prior_{m})"
    share = "(least(games_available, 4) / 4e0)"
    return (
        f"CASE WHEN {cur} IS NULL THEN {prior} WHEN {prior} IS NULL THEN {cur} "
        f"ELSE {share} * {cur} + (1 - {share}) * {prior} END"
    )


MATERIALIZED_SQL = f"""{LAGS_SQL},
{PRIORS_SQL},
strengths AS (SELECT * FROM (VALUES (0.25e0), (0.5e0), (0.75e0), (1e0)) t(prior_strength)),
materialized AS (SELECT game_id, team_id, opponent_team_id, is_home, week, kickoff_dt, season, half_life, prior_strength, games_available,
  {', '.join(f'{_blend_sql(m)} AS {m}' for m in BASE)}
  FROM lags l CROSS JOIN halves h CROSS JOIN strengths s
  LEFT JOIN priors p USING (team_id, season, half_life))"""

QUERIES = {
    "base_observations": base_observations,
    "extended_observations": extended_observations,
    "advanced_observations": advanced_observations,
    "lag_store": lag_store,
    "decayed_features": decayed_features,
    "season_priors": season_priors,
    "blended_feature_grid": blended_features,
}

_EXT = obs.BASE_METRICS + obs.PRESSURE_METRICS
ORACLES = {
    "base_observations": f"WITH {PLAYS_SQL}, {observations_sql(obs.BASE_METRICS, BASE_HAVING)} "
    + _rounded_sql("game_id, season, week, team_id", BASE, "observations"),
    "extended_observations": f"WITH {PLAYS_SQL}, {observations_sql(_EXT, BASE_HAVING)} "
    + _rounded_sql("game_id, season, week, team_id", obs.names(_EXT), "observations"),
    "advanced_observations": f"WITH {PLAYS_SQL}, {observations_sql(obs.ADVANCED_METRICS)} "
    + _rounded_sql("game_id, season, week, team_id", obs.names(obs.ADVANCED_METRICS), "observations"),
    "lag_store": f"WITH {LAGS_SQL} "
    + _rounded_sql(
        "game_id, season, week, kickoff_dt, team_id, opponent_team_id, is_home, games_available, "
        + ", ".join(f"lag{k}_kickoff_dt" for k in range(1, 5)),
        [*BASE, *[f"lag{k}_{m}" for k in range(1, 5) for m in BASE]],
        "lags",
    ),
    "decayed_features": f"WITH {LAGS_SQL} SELECT game_id, team_id, season, games_available, "
    + ", ".join(f"{r6(_decay_sql(m, '2e0'))} AS {m}" for m in BASE)
    + " FROM lags",
    "season_priors": f"WITH {LAGS_SQL}, {PRIORS_SQL} "
    + _rounded_sql("team_id, season, half_life", [f"{p}_prior_{m}" for m in BASE for p in ("team", "league")], "priors"),
    "blended_feature_grid": f"WITH {MATERIALIZED_SQL} "
    + _rounded_sql("game_id, team_id, season, half_life, prior_strength, games_available", BASE, "materialized"),
}
