"""Registered queries: training matrices of the base, extended and advanced features.

The base matrix and the opponent-adjusted rates come row by row. The other matrices are wide (up
to 56 features x 12 configurations a game): their queries give every season's and configuration's
row count and the sum of every feature.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.catalog import features as ft
from asofspark.catalog import models as md
from asofspark.catalog.bindings import GAMES_SQL, PLAYS_SQL, implied_sql, r6, rounded
from asofspark.operators import matchup as mu
from asofspark.operators import observe as obs
from asofspark.operators import temporal as tmp
from asofspark.session import checkpointed

CONFIG = mu.CONFIG
EXTENDED = obs.BASE_METRICS + obs.PRESSURE_METRICS
ADVANCED = obs.ADVANCED_METRICS
OPPONENT_PAIRS = {
    "pass_epa": ("off_wp_pass_epa", "def_wp_pass_epa"),
    "rush_epa": ("off_wp_rush_epa", "def_wp_rush_epa"),
    "pass_success": ("off_wp_pass_success_rate", "def_wp_pass_success_rate"),
    "rush_success": ("off_wp_rush_success_rate", "def_wp_rush_success_rate"),
}
_TARGETS = ["target_margin", "target_total", "spread_line", "total_line", "market_spread_probability", "market_total_probability"]


def _grid(spark, sf_dir, metrics, keep):
    """(games, lags, blended grid), the last two written once."""
    sums = ft.play_sums(spark, sf_dir, metrics)
    dim = ft.games(sums)
    observed = obs.entity_means(sums, metrics) if keep else obs.entity_means(sums.withColumn("_keep", F.lit(1)), metrics)
    rows = ft.sched.entity_rows(dim.filter("game_type = 'REG'"), ["game_id", "season", "week", "kickoff_dt"])
    names = obs.names(metrics)
    lags = checkpointed(tmp.build_lags(rows.join(observed, ["game_id", "season", "week", "team_id"], "left"), names))
    return dim, lags, checkpointed(tmp.materialize(lags, names))


def extended_rows(spark, sf_dir):
    """Eight matchup pairs and the context of every game and configuration."""
    dim, _, grid = _grid(spark, sf_dir, EXTENDED, True)
    features = {**mu.matchup_columns(mu.EXTENDED_PAIRS), **mu.context_columns()}
    return mu.training_matrix(grid, dim, obs.names(EXTENDED), features), list(features)


def advanced_features() -> dict:
    return {**mu.matchup_columns(mu.ADVANCED_PAIRS, mu.SPECIAL_TEAMS), **mu.context_columns()}


def advanced_rows(spark, sf_dir):
    """Twenty matchup pairs, opponent-adjusted ones among them, special teams and context; rare rates fall back to broader ones."""
    dim, lags, grid = _grid(spark, sf_dir, ADVANCED, False)
    adjusted = tmp.opponent_adjusted(lags, grid, OPPONENT_PAIRS)
    rows = mu.with_fallbacks(grid.join(adjusted, ["game_id", "team_id", *CONFIG], "left"))
    names = [*obs.names(ADVANCED), *(f"{s}_opp_adj_{n}" for n in OPPONENT_PAIRS for s in ("off", "def"))]
    features = advanced_features()
    return mu.training_matrix(rows, dim, names, features), list(features)


def _summed(matrix, features):
    sums = [F.round(F.sum(c), 4).alias(c) for c in (*features, *_TARGETS)]
    return rounded(matrix.groupBy("season", *CONFIG).agg(F.count(F.lit(1)).alias("rows"), *sums))


def training_matrix(spark, sf_dir):
    return rounded(md.matrix(spark, sf_dir))


def extended_matrix(spark, sf_dir):
    return _summed(*extended_rows(spark, sf_dir))


def advanced_matrix(spark, sf_dir):
    return _summed(*advanced_rows(spark, sf_dir))


def opponent_adjusted(spark, sf_dir):
    """Own rates minus the opponent's pregame strength, lagged and blended again, per game, team and configuration."""
    _, lags, grid = _grid(spark, sf_dir, obs.BASE_METRICS, True)
    return rounded(tmp.opponent_adjusted(lags, grid, mu.BASE_PAIRS))


# --- the same in SQL -------------------------------------------------------------


def grid_sql(metrics: list[obs.Metric], having: str) -> str:
    """CTEs up to ``materialized``: lags and blended means of any metrics for the whole grid."""
    names = obs.names(metrics)
    lags = ", ".join(f"lag({c}, {k}) OVER w AS lag{k}_{c}" for k in range(1, 5) for c in names)
    prior = ", ".join(
        f"sum({m} * pow(2e0, -k / half_life)) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN pow(2e0, -k / half_life) END), 0) AS team_prior_{m}" for m in names
    )
    return f"""{PLAYS_SQL}, {GAMES_SQL}, {ft.observations_sql(metrics, having)},
entity_rows AS (SELECT game_id, season, week, kickoff_dt, home_team AS team_id, away_team AS opponent_team_id, true AS is_home FROM games WHERE game_type = 'REG'
  UNION ALL SELECT game_id, season, week, kickoff_dt, away_team, home_team, false FROM games WHERE game_type = 'REG'),
team_games AS (SELECT r.*, {', '.join('o.' + m for m in names)} FROM entity_rows r
  LEFT JOIN observations o ON o.game_id = r.game_id AND o.season = r.season AND o.week = r.week AND o.team_id = r.team_id),
lags AS (SELECT *, {' + '.join(f'CASE WHEN lag{k}_{names[0]} IS NOT NULL THEN 1 ELSE 0 END' for k in range(1, 5))} AS games_available
  FROM (SELECT *, {lags} FROM team_games WINDOW w AS (PARTITION BY team_id, season ORDER BY kickoff_dt, game_id)) l0),
halves AS (SELECT * FROM (VALUES (1e0), (2e0), (4e0)) t(half_life)),
strengths AS (SELECT * FROM (VALUES (0.25e0), (0.5e0), (0.75e0), (1e0)) t(prior_strength)),
team_prior AS (SELECT team_id, season, half_life, {prior}
  FROM (SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY kickoff_dt DESC, game_id DESC) - 1 AS k FROM lags WHERE {names[0]} IS NOT NULL) t CROSS JOIN halves WHERE k < 4 GROUP BY 1, 2, 3),
league_prior AS (SELECT season, half_life, {', '.join(f'avg(team_prior_{m}) AS league_prior_{m}' for m in names)} FROM team_prior GROUP BY 1, 2),
priors AS (SELECT team_id, t.season + 1 AS season, t.half_life, {', '.join(f'team_prior_{m}, league_prior_{m}' for m in names)} FROM team_prior t JOIN league_prior l ON l.season = t.season AND l.half_life = t.half_life),
materialized AS (SELECT game_id, team_id, opponent_team_id, is_home, week, kickoff_dt, season, half_life, prior_strength, {', '.join(f'{ft._blend_sql(m)} AS {m}' for m in names)}
  FROM lags CROSS JOIN halves CROSS JOIN strengths LEFT JOIN priors USING (team_id, season, half_life))"""


def adjusted_sql(pairs: dict[str, tuple[str, str]]) -> str:
    """CTEs up to ``adjusted`` on top of :func:`grid_sql`."""
    adj = [f"{s}_opp_adj_{n}" for n in pairs for s in ("off", "def")]
    gaps = ", ".join(f"t.{o} - m.{d} AS off_opp_adj_{n}, t.{d} - m.{o} AS def_opp_adj_{n}" for n, (o, d) in pairs.items())
    w = "pow(2e0, -k / half_life)"
    prior = ", ".join(f"sum({a} * {w}) / nullif(sum(CASE WHEN {a} IS NOT NULL THEN {w} END), 0) AS team_prior_{a}" for a in adj)
    return f"""
ob AS (SELECT t.game_id, t.team_id, t.season, t.kickoff_dt, m.half_life, m.prior_strength, {gaps}
  FROM team_games t JOIN materialized m ON m.game_id = t.game_id AND m.team_id = t.opponent_team_id),
oa AS (SELECT *, {' + '.join(f'CASE WHEN lag{k}_{adj[0]} IS NOT NULL THEN 1 ELSE 0 END' for k in range(1, 5))} AS games_available FROM (
  SELECT *, {', '.join(f'lag({a}, {k}) OVER w AS lag{k}_{a}' for a in adj for k in range(1, 5))} FROM ob
  WINDOW w AS (PARTITION BY team_id, half_life, prior_strength, season ORDER BY kickoff_dt, game_id)) ol),
op AS (SELECT team_id, season + 1 AS season, half_life, prior_strength, {prior} FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id, half_life, prior_strength, season ORDER BY kickoff_dt DESC, game_id DESC) - 1 AS k FROM oa WHERE {adj[0]} IS NOT NULL) ot
  WHERE k < 4 GROUP BY 1, 2, 3, 4),
og AS (SELECT season, half_life, prior_strength, {', '.join(f'avg(team_prior_{a}) AS league_prior_{a}' for a in adj)} FROM op GROUP BY 1, 2, 3),
adjusted AS (SELECT game_id, team_id, season, half_life, prior_strength, {', '.join(f'{ft._blend_sql(a)} AS {a}' for a in adj)}
  FROM oa LEFT JOIN op USING (team_id, season, half_life, prior_strength) LEFT JOIN og USING (season, half_life, prior_strength))"""


def _matrix_sql(source: str, pairs: dict[str, tuple[str, str]], team: tuple[str, ...] = ()) -> str:
    cols = {}
    for n, (o, d) in pairs.items():
        home, away = f"(h.{o} + a.{d})", f"(a.{o} + h.{d})"
        cols |= {f"{n}_matchup_difference": f"{home} - {away}", f"{n}_matchup_sum": f"{home} + {away}"}
    for m in team:
        cols |= {f"{m}_difference": f"h.{m} - a.{m}", f"{m}_sum": f"h.{m} + a.{m}"}
    cols |= {"rest_difference": "g.home_rest - g.away_rest", "is_outdoors": "CAST(lower(g.roof) = 'outdoors' AS DOUBLE)", "is_grass": "CAST(lower(g.surface) LIKE '%grass%' AS DOUBLE)"}
    fair = lambda x, y: f"{implied_sql(x)} / ({implied_sql(x)} + {implied_sql(y)})"
    told = {
        **cols, "target_margin": "g.home_score - g.away_score", "target_total": "g.home_score + g.away_score", "spread_line": "g.spread_line", "total_line": "g.total_line",
        "market_spread_probability": fair("home_spread_odds", "away_spread_odds"), "market_total_probability": fair("over_odds", "under_odds"),
    }
    return f"""wide AS (SELECT g.season, h.half_life, h.prior_strength, {', '.join(f'{e} AS {c}' for c, e in told.items())}
  FROM games g JOIN {source} h ON h.game_id = g.game_id AND h.is_home JOIN {source} a ON a.game_id = g.game_id AND NOT a.is_home AND a.half_life = h.half_life AND a.prior_strength = h.prior_strength
  WHERE g.game_type = 'REG')
SELECT season, half_life, prior_strength, count(*) AS rows, {', '.join(f'{r6(f"round(sum({c}), 4)")} AS {c}' for c in told)} FROM wide
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in told)} GROUP BY 1, 2, 3"""


_ADJ = [f"{s}_opp_adj_{n}" for n in mu.BASE_PAIRS for s in ("off", "def")]
_FALLBACKS = {"off_short_yard_success_rate": "off_wp_rush_success_rate", "def_short_yard_success_rate": "def_wp_rush_success_rate", **{m: "st_epa" for m in mu.SPECIAL_TEAMS[2:]}}
_FILLED = ", ".join(f"coalesce({m}, {f}) AS {m}" for m, f in _FALLBACKS.items())

QUERIES = {
    "training_matrix": training_matrix,
    "extended_matrix": extended_matrix,
    "advanced_matrix": advanced_matrix,
    "opponent_adjusted": opponent_adjusted,
}
ORACLES = {
    "training_matrix": f"WITH {md.MATRIX_SQL} "
    + ft._rounded_sql(
        "game_id, season, week, half_life, prior_strength",
        [*md._FEATURE_NAMES, "target_margin", "target_total", "spread_line", "total_line", "market_spread_probability", "market_total_probability"],
        "matrix",
    ),
    "extended_matrix": f"WITH {grid_sql(EXTENDED, ft.BASE_HAVING)}, {_matrix_sql('materialized', mu.EXTENDED_PAIRS)}",
    "advanced_matrix": f"""WITH {grid_sql(ADVANCED, '')}, {adjusted_sql(OPPONENT_PAIRS)},
      joined AS (SELECT m.*, {', '.join(f'x.{s}_opp_adj_{n}' for n in OPPONENT_PAIRS for s in ('off', 'def'))} FROM materialized m LEFT JOIN adjusted x USING (game_id, team_id, half_life, prior_strength)),
      filled AS (SELECT * REPLACE ({_FILLED}) FROM joined), {_matrix_sql('filled', mu.ADVANCED_PAIRS, mu.SPECIAL_TEAMS)}""",
    "opponent_adjusted": f"WITH {grid_sql(obs.BASE_METRICS, ft.BASE_HAVING)}, {adjusted_sql(mu.BASE_PAIRS)} "
    + ft._rounded_sql("game_id, team_id, half_life, prior_strength", _ADJ, "adjusted"),
}
