"""Registered queries: walk-forward fits, distributions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.catalog import features as ft
from asofspark.catalog.bindings import SCORED_SQL, implied_sql, r6, rounded, scored, table
from asofspark.fixed_values import CALIBRATOR_C, CALIBRATOR_CLIP
from asofspark.operators import bootstrap as bs
from asofspark.operators import calibrate as cal
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators import matchup as mu
from asofspark.operators import regression as rg
from asofspark.operators import temporal as tmp
from asofspark.operators import trees as tr
from asofspark.session import checkpointed

CONFIG = mu.CONFIG
KEYS = ["market", *CONFIG, "season"]


def base_features() -> dict:
    return {**mu.matchup_columns(mu.BASE_PAIRS), "rest_difference": F.col("home_rest") - F.col("away_rest")}


def matrix(spark, sf_dir, half_lives=tmp.HALF_LIFE_GRID, strengths=tmp.PRIOR_STRENGTH_GRID):
    """The training matrix of every configuration, written once."""
    games, observed = ft.games_and_observations(spark, sf_dir)
    rows = ft.sched.entity_rows(games.filter("game_type = 'REG'"), ["game_id", "season", "week", "kickoff_dt"])
    lags = tmp.build_lags(rows.join(observed, ["game_id", "season", "week", "team_id"], "left"), ft.BASE)
    grid = tmp.materialize(lags, ft.BASE, half_lives, strengths)
    return checkpointed(mu.training_matrix(grid, games, ft.BASE, base_features()))


_PAIR_SQL = ", ".join(
    f"(h.{o} + a.{d}) - (a.{o} + h.{d}) AS {n}_matchup_difference, (h.{o} + a.{d}) + (a.{o} + h.{d}) AS {n}_matchup_sum"
    for n, (o, d) in mu.BASE_PAIRS.items()
)
_FEATURE_NAMES = [f"{n}_matchup_{s}" for n in mu.BASE_PAIRS for s in ("difference", "sum")] + ["rest_difference"]
MATRIX_SQL = f"""{ft.MATERIALIZED_SQL},
matrix AS (SELECT * FROM (SELECT g.game_id, g.season, g.week, h.half_life, h.prior_strength, {_PAIR_SQL},
  g.home_rest - g.away_rest AS rest_difference, g.home_score - g.away_score AS target_margin, g.home_score + g.away_score AS target_total,
  g.spread_line, g.total_line,
  {implied_sql('home_spread_odds')} / ({implied_sql('home_spread_odds')} + {implied_sql('away_spread_odds')}) AS market_spread_probability,
  {implied_sql('over_odds')} / ({implied_sql('over_odds')} + {implied_sql('under_odds')}) AS market_total_probability
  FROM games g JOIN materialized h ON h.game_id = g.game_id AND h.is_home
  JOIN materialized a ON a.game_id = g.game_id AND NOT a.is_home AND a.half_life = h.half_life AND a.prior_strength = h.prior_strength
  WHERE g.game_type = 'REG') m0
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_FEATURE_NAMES, 'target_margin', 'target_total', 'spread_line', 'total_line', 'market_spread_probability', 'market_total_probability'])}),
mk AS (SELECT game_id, season, week, half_life, prior_strength, {', '.join(_FEATURE_NAMES)}, 'spreads' AS market, target_margin AS target, spread_line AS line, market_spread_probability AS market_probability FROM matrix
  UNION ALL SELECT game_id, season, week, half_life, prior_strength, {', '.join(_FEATURE_NAMES)}, 'totals', target_total, total_line, market_total_probability FROM matrix)"""


_ONE = ["pass_epa_matchup_sum"]


def one_feature_oof(spark, sf_dir):
    rows = mu.by_market(matrix(spark, sf_dir))
    oof, _ = rg.out_of_fold(rows, KEYS, _ONE)
    return oof


def walk_forward(spark, sf_dir):
    """Out-of-fold projections of the grid with one feature (closed form in SQL)."""
    return rounded(one_feature_oof(spark, sf_dir).select("game_id", *KEYS, "alpha", "n_train", "raw"))


_OOF_SQL = f"""{MATRIX_SQL},
seas AS (SELECT market, half_life, prior_strength, season, count(*) AS n, sum(x) AS sx, sum(target) AS sy, sum(x * x) AS sxx, sum(x * target) AS sxy
  FROM (SELECT *, {_ONE[0]} AS x FROM mk) q GROUP BY 1, 2, 3, 4),
train AS (SELECT market, half_life, prior_strength, season, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('n', 'sx', 'sy', 'sxx', 'sxy'))} FROM seas
  WINDOW w AS (PARTITION BY market, half_life, prior_strength ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT t.*, alpha, (sxy - sx * sy / n) / ((sxx - sx * sx / n) * (n + alpha) / n) AS b FROM train t
  CROSS JOIN (VALUES (0.1e0), (1e0), (10e0), (100e0)) al(alpha) WHERE n >= 100),
oof AS (SELECT k.game_id, k.market, k.half_life, k.prior_strength, k.season, k.target, k.line, f.alpha, CAST(f.n AS BIGINT) AS n_train,
  f.sy / f.n - f.b * f.sx / f.n + f.b * k.{_ONE[0]} AS raw
  FROM mk k JOIN fit f USING (market, half_life, prior_strength, season))"""


def configuration_choice(spark, sf_dir):
    """Nested choice of configuration and penalties for every outer season."""
    stats = rg.season_stats(one_feature_oof(spark, sf_dir), ["market", *CONFIG, "alpha", "season"])
    out = rg.select_configuration(stats, CONFIG)
    return rounded(out.withColumn("season", F.coalesce("season", F.lit(0))))


def adjusted_choice(spark, sf_dir):
    """The same choice by RMSE after the market weight."""
    stats = rg.season_stats(one_feature_oof(spark, sf_dir), ["market", *CONFIG, "alpha", "season"])
    out = rg.select_configuration(stats, CONFIG, by_adjusted=True)
    return rounded(out.withColumn("season", F.coalesce("season", F.lit(0))))


def nested_evaluation(spark, sf_dir):
    """RMSE of raw, final and market projections per outer season and market."""
    oof = checkpointed(one_feature_oof(spark, sf_dir))
    choice = rg.select_configuration(rg.season_stats(oof, ["market", *CONFIG, "alpha", "season"]), CONFIG)
    nested = rg.nested_predictions(oof, choice, CONFIG)
    return rounded(ev.projection_metrics(nested, ["season", "market"], "target", ["raw", "final", "line"]))


_STATS = ("n", "see", "sy", "syy", "sdd", "sdr", "srr")


def _choice_sql(adjusted: bool, oof: str = _OOF_SQL) -> str:
    sse = "srr - 2 * mw * sdr + mw * mw * sdd" if adjusted else "see"
    return f"""{oof},
st AS (SELECT market, half_life, prior_strength, alpha, season, count(*) AS n, sum((target - raw) * (target - raw)) AS see, sum(target) AS sy, sum(target * target) AS syy,
  sum((raw - line) * (raw - line)) AS sdd, sum((raw - line) * (target - line)) AS sdr, sum((target - line) * (target - line)) AS srr FROM oof GROUP BY 1, 2, 3, 4, 5),
pool AS (SELECT * FROM (SELECT market, half_life, prior_strength, alpha, season, {', '.join(f'sum({c}) OVER w AS {c}' for c in _STATS)} FROM st
    WINDOW w AS (PARTITION BY market, half_life, prior_strength, alpha ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b WHERE n >= 100
  UNION ALL SELECT market, half_life, prior_strength, alpha, 0, {', '.join(f'sum({c})' for c in _STATS)} FROM st GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 100),
pw AS (SELECT *, CASE WHEN sdd <= 1e-12 THEN 0 ELSE greatest(0, least(1, sdr / sdd)) END AS mw FROM pool),
pr AS (SELECT *, sqrt(({sse}) / n) AS rmse FROM pw),
ps AS (SELECT *, rmse / greatest(sqrt((syy - sy * sy / n) / (n - 1)), 1e-9) AS norm FROM pr),
rd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, market, half_life, prior_strength ORDER BY rmse, alpha) AS rn FROM ps) z WHERE rn = 1),
cs AS (SELECT season, half_life, prior_strength, avg(norm) AS score FROM rd GROUP BY 1, 2, 3 HAVING count(*) = 2),
bestc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY score, half_life, prior_strength) AS rn FROM cs) z WHERE rn = 1),
choice AS (SELECT b.season, b.half_life, b.prior_strength, b.score, r.market, r.alpha, r.rmse, r.mw AS market_weight, CAST(r.n AS BIGINT) AS inner_rows
  FROM bestc b JOIN rd r USING (season, half_life, prior_strength))"""


_CHOICE_OUT = f"""SELECT season, half_life, prior_strength, {r6('score')} AS score, market, alpha, {r6('rmse')} AS rmse,
  {r6('market_weight')} AS market_weight, inner_rows FROM choice"""


def training_sums(spark, sf_dir):
    """Counts, means and centred products of all earlier seasons, combined from the seasons' blocks."""
    rows = mu.by_market(matrix(spark, sf_dir))
    blocks = rg.training_blocks(rg.gram_blocks(rows, KEYS, _ONE), KEYS)
    return rounded(blocks.select(*KEYS, F.posexplode("block").alias("cell", "v")).withColumn("v", F.round("v", 3)))


def full_walk_forward(spark, sf_dir):
    """All features, configurations and penalties; the chosen nested projections."""
    rows = mu.by_market(matrix(spark, sf_dir))
    names = list(base_features())
    oof, _ = rg.out_of_fold(rows, KEYS, names)
    oof = checkpointed(oof)
    choice = rg.select_configuration(rg.season_stats(oof, ["market", *CONFIG, "alpha", "season"]), CONFIG)
    nested = rg.nested_predictions(oof, choice, CONFIG)
    return rounded(nested.select("game_id", "season", "market", *CONFIG, "alpha", "market_weight", "raw", "final", "line", "target"))


def coefficient_table(spark, sf_dir):
    """Standardised coefficients of every fold, configuration and penalty."""
    rows = mu.by_market(matrix(spark, sf_dir))
    names = list(base_features())
    train = rg.training_blocks(rg.gram_blocks(rows, KEYS, names), KEYS)
    return rounded(rg.coefficient_table(rg.solve_folds(train, KEYS, names), names))


def _feature_sets() -> dict[str, list[str]]:
    names = _FEATURE_NAMES
    return {
        "passing": [n for n in names if n.startswith("pass")],
        "rushing": [n for n in names if n.startswith("rush")],
        "passing+rushing": [n for n in names if n != "rest_difference"],
        "all": names,
    }


def feature_set_grid(spark, sf_dir):
    """Feature subsets from one block, for every configuration: market weights of the residual fits."""
    rows = mu.by_market(matrix(spark, sf_dir))
    names = list(base_features())
    train = rg.training_blocks(rg.gram_blocks(rows, KEYS, names), KEYS)
    coefs = rg.solve_folds(train, KEYS, names, feature_sets=_feature_sets(), min_train=30, residual_target=True)
    return rounded(coefs.select(*KEYS, "feature_set", "n_features", "alpha", "n_train", "train_weight"))


def ridge_sql(rows: str, features: list[str], sets: dict[str, list[str]], min_train: int = 100, residual: bool = False, name: str = "fit") -> str:
    """Recursive CTEs: standardised ridge of every fold, set and penalty over ``rows``, by elimination on centred products."""
    y = "(k.target - k.line)" if residual else "k.target"
    x = [f"k.{f}" for f in features]
    n = len(features)
    cov = lambda a, b: f"count(*) * covar_pop({a}, {b})"
    c = ", ".join("[" + ", ".join(cov(x[min(i, j)], x[max(i, j)]) for j in range(n)) + "]" for i in range(n))
    chosen = ", ".join(f"('{s}', [{', '.join(str(features.index(f) + 1) for f in fs)}])" for s, fs in sets.items())
    keys = "market, half_life, prior_strength, season"
    return f"""
{name}_folds AS (SELECT DISTINCT {keys} FROM {rows}),
{name}_g AS (SELECT f.market, f.half_life, f.prior_strength, f.season, count(*) AS n, [{', '.join(f'avg({v})' for v in x)}] AS mu, avg({y}) AS ym, [{c}] AS c, [{', '.join(cov(v, y) for v in x)}] AS b
  FROM {name}_folds f JOIN {rows} k ON k.market = f.market AND k.half_life = f.half_life AND k.prior_strength = f.prior_strength AND k.season < f.season
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= {min_train}),
{name}_s AS (SELECT *, list_transform(range(1, {n + 1}), lambda i: sqrt(c[i][i] / n)) AS sd FROM {name}_g),
{name}_elim(k, {keys}, feature_set, idx, alpha, m) AS (
  SELECT 0, {keys}, feature_set, idx, alpha, list_transform(idx, lambda i: list_concat(list_transform(idx, lambda j: c[i][j] / (sd[i] * sd[j]) + CASE WHEN i = j THEN alpha ELSE 0e0 END), [b[i] / sd[i]]))
  FROM {name}_s, (VALUES {chosen}) v(feature_set, idx), (VALUES (0.1e0), (1e0), (10e0), (100e0)) al(alpha)
  UNION ALL
  SELECT k + 1, {keys}, feature_set, idx, alpha, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1])
    ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name}_elim WHERE k < len(idx)),
{name} AS (SELECT e.market, e.half_life, e.prior_strength, e.season, e.feature_set, len(e.idx) AS n_features, e.alpha, s.n AS n_train, s.sd,
  list_transform(range(1, {n + 1}), lambda i: coalesce(m[list_position(idx, i)][len(idx) + 1] / s.sd[i], 0e0)) AS coef, s.mu, s.ym
  FROM {name}_elim e JOIN {name}_s s USING ({keys}) WHERE k = len(idx))"""


def fitted_sql(features: list[str], row: str = "k", fit: str = "f") -> str:
    """A row's projection under a fit of :func:`ridge_sql`."""
    return f"{fit}.ym + " + " + ".join(f"{fit}.coef[{i}] * ({row}.{f} - {fit}.mu[{i}])" for i, f in enumerate(features, 1))


_ALL_OOF_SQL = f"""{MATRIX_SQL},{ridge_sql('mk', _FEATURE_NAMES, {'all': _FEATURE_NAMES})},
oof AS (SELECT k.game_id, k.market, k.half_life, k.prior_strength, k.season, k.target, k.line, f.alpha, f.n_train, {fitted_sql(_FEATURE_NAMES)} AS raw
  FROM mk k JOIN fit f USING (market, half_life, prior_strength, season))"""


def _distribution_rows(spark, sf_dir):
    rows = mu.by_market(matrix(spark, sf_dir, [2.0], [0.5]))
    return rows.withColumn("final", F.col("line") + 0.25 * F.col("rest_difference"))


def residual_probabilities(spark, sf_dir):
    """Win, push and loss of later games from the residuals of earlier ones."""
    rows = checkpointed(_distribution_rows(spark, sf_dir))
    model = ds.fit_distribution(rows.filter("season < 1999"), ["market"])
    out = ds.score_distribution(model, rows.filter("season >= 1999"), ["game_id"])
    return rounded(out.select("game_id", "market", "p_win", "p_push", "p_loss"))


_KEYLIST = "(-14), (-10), (-7), (-6), (-3), (3), (6), (7), (10), (14)"


def distribution_sql(rows: str, asked: str, ids: str) -> str:
    """CTEs of the residual distribution: learned from ``rows`` (market, target, final, sv), asked by ``asked`` (ids, market, line, t, sv)."""
    q = ", ".join(f"q.{c.strip()}" for c in ids.split(","))
    return f"""
tr AS (SELECT market, target AS a, target - final AS res, sv FROM {rows}),
ed AS (SELECT market, quantile_cont(sv, 1e0 / 3) AS q0, quantile_cont(sv, 2e0 / 3) AS q1 FROM tr GROUP BY 1),
loc AS (SELECT tr.*, CASE WHEN sv > q0 THEN 1 ELSE 0 END + CASE WHEN sv > q1 THEN 1 ELSE 0 END AS st FROM tr JOIN ed USING (market)),
both_st AS (SELECT market, a, res, st FROM loc UNION ALL SELECT market, a, res, -1 FROM loc),
keyk AS (SELECT k::DOUBLE AS k FROM (VALUES {_KEYLIST}) t(k)),
flag AS (SELECT *, market = 'spreads' AND a IN (SELECT k FROM keyk) AS onkey FROM both_st),
prof AS (SELECT market, st, count(*) AS n, count(*) FILTER (NOT onkey) AS np FROM flag GROUP BY 1, 2 HAVING count(*) >= 30),
mass AS (SELECT f.market, f.st, k.k, count(*) FILTER (f.a = k.k AND f.market = 'spreads') / count(*)::DOUBLE AS m FROM flag f CROSS JOIN keyk k GROUP BY 1, 2, 3),
pts AS (SELECT market, st, res, count(*) AS c FROM flag WHERE NOT onkey GROUP BY 1, 2, 3),
qs AS (SELECT {ids}, market, line, t, 1e-8 + 1e-5 * abs(line) AS tol,
  CASE WHEN sv > q0 THEN 1 ELSE 0 END + CASE WHEN sv > q1 THEN 1 ELSE 0 END AS st FROM {asked} JOIN ed USING (market)),
qx AS (SELECT *, st AS us FROM qs UNION ALL SELECT *, -1 FROM qs),
uq AS (SELECT DISTINCT market, us, t, tol, line FROM qx),
cnt AS (SELECT u.market, u.us, u.t, u.tol, u.line, sum(CASE WHEN p.res > u.t THEN c ELSE 0 END) AS gt, sum(CASE WHEN p.res < u.t THEN c ELSE 0 END) AS lt,
  sum(CASE WHEN p.res BETWEEN u.t - u.tol AND u.t + u.tol THEN c ELSE 0 END) AS eq
  FROM uq u JOIN pts p ON p.market = u.market AND p.st = u.us GROUP BY 1, 2, 3, 4, 5),
km AS (SELECT u.market, u.us, u.t, u.tol, u.line, sum(m) AS allm, sum(CASE WHEN k > u.line THEN m ELSE 0 END) AS mg, sum(CASE WHEN k < u.line THEN m ELSE 0 END) AS ml,
  sum(CASE WHEN k = u.line THEN m ELSE 0 END) AS me FROM uq u JOIN mass ms ON ms.market = u.market AND ms.st = u.us GROUP BY 1, 2, 3, 4, 5),
raw3 AS (SELECT c.market, c.us, c.t, c.tol, c.line, pr.n, greatest(0, 1 - allm) * gt / np + mg AS w, greatest(0, 1 - allm) * eq / np + me AS p, greatest(0, 1 - allm) * lt / np + ml AS l
  FROM cnt c JOIN km USING (market, us, t, tol, line) JOIN prof pr ON pr.market = c.market AND pr.st = c.us),
u3 AS (SELECT market, us, t, tol, line, n, w / (w + p + l) AS w, p / (w + p + l) AS p, l / (w + p + l) AS l FROM raw3),
mix AS (SELECT {q}, q.market, {', '.join(f"CASE WHEN s.n IS NULL THEN g.{c} ELSE s.n / (s.n + 200e0) * s.{c} + (1 - s.n / (s.n + 200e0)) * g.{c} END AS {c}" for c in 'wpl')}
  FROM qs q JOIN u3 g ON g.market = q.market AND g.us = -1 AND g.t = q.t AND g.tol = q.tol AND g.line = q.line
  LEFT JOIN u3 s ON s.market = q.market AND s.us = q.st AND s.t = q.t AND s.tol = q.tol AND s.line = q.line)"""


RESIDUAL_ROWS_SQL = f"""{MATRIX_SQL},
d AS (SELECT *, line + 0.25e0 * rest_difference AS final, CASE WHEN market = 'spreads' THEN abs(line) ELSE line END AS sv FROM mk WHERE half_life = 2 AND prior_strength = 0.5e0)"""
_DIST_SQL = f"""{RESIDUAL_ROWS_SQL},
early AS (SELECT * FROM d WHERE season < 1999), late AS (SELECT *, line - final AS t FROM d WHERE season >= 1999),{distribution_sql('early', 'late', 'game_id')}"""


def calibrated_probabilities(spark, sf_dir):
    """Calibration of the fact-level probabilities per market, by Spark ML."""
    return rounded(cal.fit_by_group(scored(spark, sf_dir), "market", "model_probability", "outcome"))


def scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = ev.probability_metrics(s, ["market", "season"], "outcome", ["model_probability", "market_probability"])
    q = ev.projection_metrics(s, ["market", "season"], "actual", ["projection", "line"]).drop("rows")
    return rounded(p.join(q, ["market", "season"]))


def reliability(spark, sf_dir):
    return rounded(ev.reliability(scored(spark, sf_dir), ["market"], "model_probability", "outcome"))


def calibration_error(spark, sf_dir):
    return rounded(ev.calibration_error(scored(spark, sf_dir), ["market"], "model_probability", "outcome"))


def probability_bundle(spark, sf_dir):
    out = ev.probability_bundle(scored(spark, sf_dir), ["market", "season", "week"], "model_probability", "outcome", "actual", "projection", "line")
    return rounded(out.withColumn("margin", ev.probability_margin("brier", "non_push_rows")))


def edge_monotonicity(spark, sf_dir):
    order = ["l_orderkey", "actual", "line", "model_probability", "outcome", "week", "season"]
    return rounded(ev.edge_monotonicity(scored(spark, sf_dir), "model_probability", "market_probability", "outcome", order))


def _gate_metrics(spark, sf_dir):
    s = scored(spark, sf_dir)
    m = ev.probability_metrics(s, ["market"], "outcome", ["model_probability", "market_probability"])
    fit = cal.fit_by_group(s, "market", "model_probability", "outcome")
    return m.join(fit.drop("rows"), "market").select(
        "market", "slope", "intercept",
        F.col("model_probability_brier").alias("model_brier"), F.col("market_probability_brier").alias("market_brier"),
        F.col("model_probability_log_loss").alias("model_log_loss"), F.col("market_probability_log_loss").alias("market_log_loss"),
    )


def promotion_gates(spark, sf_dir):
    return ev.promotion_gates(_gate_metrics(spark, sf_dir))


def gate_verdict(spark, sf_dir):
    return ev.verdict(ev.promotion_gates(_gate_metrics(spark, sf_dir)))


def ablation(spark, sf_dir):
    return rounded(ev.ablation_deltas(scored(spark, sf_dir), "outcome", "market_probability", "model_probability"))


def version_comparison(spark, sf_dir):
    """Two versions on matched contracts with unmatched counts."""
    o = table(spark, sf_dir, "orders")
    base = o.select(
        "o_orderkey", F.expr("CASE WHEN o_orderstatus = 'F' THEN 'spreads' ELSE 'totals' END").alias("market"),
        F.expr("CASE WHEN o_orderpriority < '3' THEN 1e0 ELSE 0e0 END").alias("y"), F.expr("0.3e0 + (o_custkey % 40) / 100e0").alias("p"),
        F.expr("0.35e0 + (o_custkey % 30) / 100e0").alias("q"), "o_orderstatus", "o_orderpriority",
    )
    cand = base.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", "market", "y", "p")
    other = base.filter("o_orderstatus <> 'P'").select("o_orderkey", "market", "y", F.col("q").alias("p"))
    return rounded(ev.matched_comparison(cand, other, ["o_orderkey", "market"], "y", "p"))


def season_bootstrap(spark, sf_dir):
    """Season-block bootstrap interval of the RMSE difference per market."""
    return rounded(bs.rmse_difference(scored(spark, sf_dir), None, "actual", "projection", "line", "season"))


def paired_bootstrap(spark, sf_dir):
    return rounded(bs.paired_scores(scored(spark, sf_dir), None, "outcome", "model_probability", "market_probability"))


def ablation_acceptance(spark, sf_dir):
    rows = scored(spark, sf_dir)
    deltas = ev.ablation_deltas(rows, "outcome", "market_probability", "model_probability")
    return rounded(ev.ablation_acceptance(deltas, bs.paired_scores(rows, None, "outcome", "model_probability", "market_probability", 2_000, 202603)))


def market_weights(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(
        s.groupBy("market", "season").agg(
            rg.market_weight(F.col("projection") - F.col("line"), F.col("actual") - F.col("line")).alias("market_weight")
        )
    )


def standardized_fold(spark, sf_dir):
    """Train-only mean and population sd applied to later rows."""
    s = scored(spark, sf_dir)
    train = s.filter("season < 1999")
    stats = train.agg(F.avg("projection").alias("m"), F.stddev_pop("projection").alias("sd"))
    z = s.filter("season >= 1999").withColumn("z", (F.col("projection") - stats.select("m").scalar()) / stats.select("sd").scalar())
    return rounded(z.groupBy("market", "season").agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z")))


def tree_projections(spark, sf_dir):
    """Walk-forward projections of both markets by ridge, boosted trees (200 rounds) and their blends."""
    rows = checkpointed(mu.by_market(matrix(spark, sf_dir, [2.0], [0.5])))
    names = list(base_features())
    seasons = [r[0] for r in rows.select("season").distinct().collect()]
    trees = tr.tree_out_of_fold(rows, names, seasons, min_train=100)
    ridge, _ = rg.out_of_fold(rows, KEYS, names, (10.0,))
    both = trees.join(ridge.select("game_id", "market", F.col("raw").alias("ridge_raw")), ["game_id", "market"])
    blends = [tr.blend("ridge_raw", "tree_raw", b).alias(b) for b in ("blend_25", "blend_50", "blend_75")]
    return both.select("game_id", "market", "season", "line", "target", "ridge_raw", "tree_raw", *blends)


QUERIES = {
    "training_sums": training_sums,
    "walk_forward": walk_forward,
    "configuration_choice": configuration_choice,
    "adjusted_choice": adjusted_choice,
    "nested_evaluation": nested_evaluation,
    "full_walk_forward": full_walk_forward,
    "coefficient_table": coefficient_table,
    "feature_set_grid": feature_set_grid,
    "residual_probabilities": residual_probabilities,
    "calibrated_probabilities": calibrated_probabilities,
    "scores": scores,
    "reliability": reliability,
    "calibration_error": calibration_error,
    "probability_bundle": probability_bundle,
    "edge_monotonicity": edge_monotonicity,
    "promotion_gates": promotion_gates,
    "gate_verdict": gate_verdict,
    "ablation_deltas": ablation,
    "ablation_acceptance": ablation_acceptance,
    "version_comparison": version_comparison,
    "season_bootstrap": season_bootstrap,
    "paired_bootstrap": paired_bootstrap,
    "market_weights": market_weights,
    "standardized_fold": standardized_fold,
    "tree_projections": tree_projections,
}


def _clip(p: str) -> str:
    return f"greatest(1e-8, least(1 - 1e-8, {p}))"


def _brier(p: str, y: str = "outcome") -> str:
    return f"pow({_clip(p)} - {y}, 2)"


def _ll(p: str, y: str = "outcome") -> str:
    return f"(-({y} * ln({_clip(p)}) + (1 - {y}) * ln(1 - {_clip(p)})))"


_BIN = "CAST(least(floor(greatest(0, least(1, {p})) * 10), 9) + 1 AS INT)"
_CELLS = [("x", "x"), ("x", "target"), ("x", "line"), ("target", "target"), ("target", "line"), ("line", "line")]
_CLIPPED = f"greatest({CALIBRATOR_CLIP}, least(1 - {CALIBRATOR_CLIP}, model_probability))"
# Newton steps on merged pairs, damped as in the operator; the CTEs need WITH RECURSIVE
_FIT_SQL = f"""pairs AS (SELECT market, ln({_CLIPPED} / (1 - {_CLIPPED})) AS x, outcome AS y, count(*)::DOUBLE AS w FROM scored GROUP BY 1, 2, 3),
  tot AS (SELECT market, sum(w) AS n, sum(w * y) AS pos FROM pairs GROUP BY 1),
  newton(k, market, a, b) AS (
    SELECT 0, market, ln(pos / (n - pos)), 0e0 FROM tot WHERE pos > 0 AND pos < n
    UNION ALL
    SELECT k + 1, market, a - da * least(1, 4 / greatest(abs(da), abs(db), 1e-300)), b - db * least(1, 4 / greatest(abs(da), abs(db), 1e-300)) FROM (
      SELECT k, market, a, b, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS da, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS db FROM (
        SELECT k, market, a, b, sum(w * (p - y)) AS g0, sum(w * (p - y) * x) + b / {CALIBRATOR_C} AS g1, sum(w * p * (1 - p)) AS h00,
          sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + 1 / {CALIBRATOR_C} AS h11
        FROM (SELECT k, market, a, b, x, y, w, 1 / (1 + exp(-(a + b * x))) AS p FROM newton JOIN pairs USING (market) WHERE k < 25) GROUP BY k, market, a, b))),
  fit AS (SELECT tot.market, a AS icpt, b AS slope, CASE WHEN a IS NULL THEN pos / n END AS const, n FROM tot LEFT JOIN (SELECT * FROM newton WHERE k = 25) USING (market))"""
_GATES_SQL = f"""WITH RECURSIVE {SCORED_SQL}, {_FIT_SQL}, m AS (SELECT market, any_value(slope) AS slope, any_value(icpt) AS icpt,
    avg({_brier('model_probability')}) AS mb, avg({_brier('market_probability')}) AS kb, avg({_ll('model_probability')}) AS ml, avg({_ll('market_probability')}) AS kl FROM scored JOIN fit USING (market) GROUP BY 1),
  g AS (SELECT CASE market WHEN 'spreads' THEN 'spread' ELSE 'total' END || '_brier_beats_market' AS gate, mb < kb AS passed FROM m
    UNION ALL SELECT CASE market WHEN 'spreads' THEN 'spread' ELSE 'total' END || '_log_loss_beats_market', ml < kl FROM m
    UNION ALL SELECT CASE market WHEN 'spreads' THEN 'spread' ELSE 'total' END || '_calibration_acceptable', abs(icpt) <= 0.2 AND slope BETWEEN 0.5 AND 1.5 FROM m)"""

_2_64 = "18446744073709551616::UHUGEINT"


def _mixed_sql(x: str) -> list[str]:
    """The generator's mixer, a step of CTE columns at a time."""
    times = lambda c: f"((z::UHUGEINT * {c}::UHUGEINT) % {_2_64})::UBIGINT"
    return [f"{x}", "xor(z, z >> 30)", times(bs.MIX_1), "xor(z, z >> 27)", times(bs.MIX_2), "xor(z, z >> 31)"]


def _poisson_sql(powers: int) -> str:
    """The fixed Poisson tables as rows (k, word, v), from the words where the value steps up."""
    rows = []
    for k in range(powers):
        table = bs.poisson_table(float(1 << k)).astype(int)
        starts = [0, *(int(i) + 1 for i in (table[1:] != table[:-1]).nonzero()[0]), 65536]
        rows += [f"({k}, {a}, {b}, {table[a]})" for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return f"ptab AS (SELECT k, unnest(range(a, b)) AS word, v FROM (VALUES {', '.join(rows)}) p(k, a, b, v))"


def replicates_sql(values: dict[str, str], identity: list[str], samples: int, seed: int, block: str | None = None, powers: int = 9) -> str:
    """CTEs up to ``reps`` (r, weight, values): the draws of ``bootstrap.replicate_sums`` over ``scored``."""
    chain = lambda name, source, keep, x: ", ".join(
        f"{name}{i} AS (SELECT {keep}, {e} AS z FROM {source if i == 0 else f'{name}{i - 1}'})" for i, e in enumerate(_mixed_sql(x)))
    word = "CAST((z >> (16 * j)) & 65535 AS INT)"
    hexed = lambda t: f"('0x' || substr(md5({t}), 1, 16))"
    step = f"((g::UHUGEINT * {bs.STEP}::UHUGEINT) % {_2_64})::UBIGINT"
    power = f"((h::UHUGEINT + (k::UHUGEINT * {bs.POWER_STEP}::UHUGEINT) % {_2_64}) % {_2_64})::UBIGINT"
    b = f"substr(md5(concat_ws('|', '{seed}', 'block', CAST({block} AS VARCHAR))), 1, 16)" if block else "'0'"
    ids = ", ".join(f"CAST(round({c} * 1e9) AS BIGINT) AS i{i}" for i, c in enumerate(identity))
    marks = ", ".join(f"i{i}" for i in range(len(identity)))
    text = f"concat_ws('|', '{seed}', b, {', '.join(f'CAST(i{i} AS VARCHAR)' for i in range(len(identity)))})"
    reps = f"range(0, {-(-samples // 4)})"
    return f"""{_poisson_sql(powers)},
tup AS (SELECT b, {marks}, count(*) AS n, {', '.join(f'min({v}) AS {v}' for v in values)} FROM (SELECT {b} AS b, {ids}, {', '.join(f'{e} AS {v}' for v, e in values.items())} FROM scored) s0 GROUP BY b, {marks}),
tid AS (SELECT row_number() OVER (ORDER BY b, {marks}) AS t, b, n, {', '.join(values)}, {hexed(text)}::UBIGINT AS h FROM tup),
blk AS (SELECT DISTINCT b, ('0x' || b)::UBIGINT AS h FROM tup),
{chain('bz', f'(SELECT b, h, g FROM blk, unnest({reps}) g1(g))', 'b, g', f'xor(h, {step})')},
times AS (SELECT b, 4 * g + j AS r, {'v' if block else '1'} AS m FROM (SELECT b, g, j, {word} AS word FROM bz5, unnest(range(0, 4)) j1(j)) x JOIN ptab ON ptab.k = 0 AND ptab.word = x.word),
need AS (SELECT t, k, g, h, max(((n * m) >> k) & 1) AS used FROM tid JOIN (SELECT b, r, m, r // 4 AS g FROM times WHERE r < {samples}) USING (b), unnest(range(0, {powers})) k1(k) WHERE n * m >= (1 << k) GROUP BY 1, 2, 3, 4),
{chain('rz', '(SELECT * FROM need WHERE used = 1)', 't, k, g', f'xor({power}, {step})')},
wrd AS (SELECT t, k, 4 * g + j AS r, {word} AS word FROM rz5, unnest(range(0, 4)) j1(j)),
reps AS (SELECT w.r, sum(p.v)::DOUBLE AS weight, {', '.join(f'sum(p.v * tid.{v}) AS {v}' for v in values)}
  FROM wrd w JOIN tid USING (t) JOIN times m ON m.b = tid.b AND m.r = w.r JOIN ptab p ON p.k = w.k AND p.word = w.word
  WHERE w.r < {samples} AND (((tid.n * m.m) >> w.k) & 1) = 1 GROUP BY 1)"""


def _interval_sql(statistics: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {r6(f'quantile_cont({e}, 0.025)')} AS lower_95, {r6(f'quantile_cont({e}, 0.5)')} AS median, {r6(f'quantile_cont({e}, 0.975)')} AS upper_95 FROM reps WHERE weight > 0"
        for n, e in statistics.items())


_PAIRED = {
    "brier": f"{_brier('model_probability')} - {_brier('market_probability')}",
    "log_loss": f"{_ll('model_probability')} - ({_ll('market_probability')})",
}
_PAIR_IDS = ["outcome", "model_probability", "market_probability"]
_DELTAS_SQL = f"""r AS (SELECT 'baseline' AS role, market_probability AS p, outcome AS y FROM scored UNION ALL SELECT 'candidate', model_probability, outcome FROM scored),
      b AS (SELECT role, {_BIN.format(p='p')} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r, sum(pow(p - y, 2)) AS sb, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS sl FROM r GROUP BY 1, 2),
      s AS (SELECT role, sum(sb) / sum(n) AS brier, sum(sl) / sum(n) AS log_loss, sum(n * abs(mp - r)) / sum(n) AS calibration_error, CAST(sum(n) AS BIGINT) AS rows FROM b GROUP BY 1)"""
_DELTAS = ", ".join(f"{r6(f'b.{m}')} AS baseline_{m}, {r6(f'c.{m}')} AS candidate_{m}, {r6(f'c.{m} - b.{m}')} AS {m}_delta" for m in ("brier", "log_loss", "calibration_error"))

ORACLES = {
    "season_bootstrap": f"""WITH {SCORED_SQL}, {replicates_sql({'ef': 'pow(actual - projection, 2)', 'el': 'pow(actual - line, 2)'}, ['actual', 'projection', 'line'], 1000, 20_260_913, 'season')}
      {_interval_sql({'final_minus_market_rmse': 'sqrt(ef / weight) - sqrt(el / weight)'})}""",
    "paired_bootstrap": f"WITH {SCORED_SQL}, {replicates_sql(_PAIRED, _PAIR_IDS, 1000, 20_260_913)} {_interval_sql({'brier': 'brier / weight', 'log_loss': 'log_loss / weight'})}",
    "ablation_acceptance": f"""WITH {SCORED_SQL}, {replicates_sql(_PAIRED, _PAIR_IDS, 2000, 202603)}, {_DELTAS_SQL},
      u AS (SELECT quantile_cont(brier / weight, 0.975) AS bu, quantile_cont(log_loss / weight, 0.975) AS lu FROM reps WHERE weight > 0)
      SELECT c.rows, {_DELTAS}, {r6('bu')} AS brier_upper, {r6('lu')} AS log_loss_upper,
        c.brier < b.brier AND c.log_loss < b.log_loss AND bu < 0 AND lu < 0 AND c.calibration_error <= b.calibration_error AS meets_research_acceptance
      FROM s c JOIN s b ON c.role = 'candidate' AND b.role = 'baseline', u""",
    "training_sums": f"""WITH {MATRIX_SQL}, x AS (SELECT *, {_ONE[0]} AS x FROM mk), se AS (SELECT DISTINCT market, half_life, prior_strength, season FROM x),
      g AS (SELECT s.market, s.half_life, s.prior_strength, s.season, [count(*), avg(x), avg(target), avg(line), {', '.join(f'count(*) * covar_pop({a}, {b})' for a, b in _CELLS)}] AS v
        FROM se s JOIN x ON x.market = s.market AND x.half_life = s.half_life AND x.prior_strength = s.prior_strength AND x.season < s.season GROUP BY 1, 2, 3, 4)
      SELECT market, half_life, prior_strength, season, CAST(i - 1 AS INT) AS cell, round(v[i], 3) + 0e0 AS v FROM g, unnest(range(1, 11)) u(i)""",
    "full_walk_forward": f"""WITH RECURSIVE {_choice_sql(False, _ALL_OOF_SQL)}
      SELECT o.game_id, o.season, o.market, o.half_life, o.prior_strength, o.alpha, {r6('c.market_weight')} AS market_weight, {r6('o.raw')} AS raw,
        {r6('c.market_weight * o.raw + (1 - c.market_weight) * o.line')} AS final, {r6('o.line')} AS line, {r6('o.target')} AS target
      FROM oof o JOIN choice c USING (season, market, half_life, prior_strength, alpha)""",
    "coefficient_table": f"""WITH RECURSIVE {MATRIX_SQL},{ridge_sql('mk', _FEATURE_NAMES, {'all': _FEATURE_NAMES})},
      named AS (SELECT *, unnest([{', '.join(f"'{f}'" for f in _FEATURE_NAMES)}]) AS feature, unnest(range(1, {len(_FEATURE_NAMES) + 1})) AS i FROM fit)
      SELECT market, half_life, prior_strength, season, feature_set, CAST(n_features AS INT) AS n_features, alpha, n_train, feature, {r6('coef[i] * sd[i]')} AS standardized_coefficient FROM named""",
    "feature_set_grid": f"""WITH RECURSIVE {MATRIX_SQL},{ridge_sql('mk', _FEATURE_NAMES, _feature_sets(), 30, True)},
      w AS (SELECT f.market, f.half_life, f.prior_strength, f.season, f.feature_set, f.n_features, f.alpha, f.n_train, {fitted_sql(_FEATURE_NAMES)} AS d, k.target - k.line AS r
        FROM fit f JOIN mk k ON k.market = f.market AND k.half_life = f.half_life AND k.prior_strength = f.prior_strength AND k.season < f.season)
      SELECT market, half_life, prior_strength, season, feature_set, CAST(n_features AS INT) AS n_features, alpha, n_train,
        {r6('CASE WHEN sum(d * d) <= 1e-12 THEN 0 ELSE greatest(0, least(1, sum(d * r) / sum(d * d))) END')} AS train_weight FROM w GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "walk_forward": f"WITH {_OOF_SQL} SELECT game_id, market, half_life, prior_strength, season, alpha, n_train, {r6('raw')} AS raw FROM oof",
    "configuration_choice": f"WITH {_choice_sql(False)} {_CHOICE_OUT}",
    "adjusted_choice": f"WITH {_choice_sql(True)} {_CHOICE_OUT}",
    "nested_evaluation": f"""WITH {_choice_sql(False)}, ne AS (SELECT o.*, c.market_weight * o.raw + (1 - c.market_weight) * o.line AS final
        FROM oof o JOIN choice c USING (season, market, half_life, prior_strength, alpha))
      SELECT season, market, count(*) AS rows, {', '.join(f"{r6(f'sqrt(avg(pow(target - {p}, 2)))')} AS {p}_rmse, {r6(f'avg(abs(target - {p}))')} AS {p}_mae" for p in ('raw', 'final', 'line'))} FROM ne GROUP BY 1, 2""",
    "residual_probabilities": f"WITH {_DIST_SQL} SELECT game_id, market, {r6('w')} AS p_win, {r6('p')} AS p_push, {r6('l')} AS p_loss FROM mix",
    "scores": f"""WITH {SCORED_SQL} SELECT market, season, count(*) AS rows, {', '.join(f"{r6(f'avg({_brier(p)})')} AS {p}_brier, {r6(f'avg({_ll(p)})')} AS {p}_log_loss" for p in ('model_probability', 'market_probability'))},
      {', '.join(f"{r6(f'sqrt(avg(pow(actual - {p}, 2)))')} AS {p}_rmse, {r6(f'avg(abs(actual - {p}))')} AS {p}_mae" for p in ('projection', 'line'))} FROM scored GROUP BY 1, 2""",
    "reliability": f"""WITH {SCORED_SQL} SELECT market, {_BIN.format(p='model_probability')} AS bin, count(*) AS count, {r6('avg(model_probability)')} AS mean_probability, {r6('avg(outcome)')} AS observed_rate FROM scored GROUP BY 1, 2""",
    "calibration_error": f"""WITH {SCORED_SQL}, b AS (SELECT market, {_BIN.format(p='model_probability')} AS bin, count(*) AS n, avg(model_probability) AS mp, avg(outcome) AS r FROM scored GROUP BY 1, 2)
      SELECT market, {r6('sum(n * abs(mp - r)) / sum(n)')} AS calibration_error FROM b GROUP BY 1""",
    "probability_bundle": f"""WITH {SCORED_SQL}, a AS (SELECT market, season, week, count(*) AS rows, count(*) FILTER (abs(actual - line) > 1e-9) AS n,
        avg({_ll('model_probability')}) FILTER (abs(actual - line) > 1e-9) AS ll, avg({_brier('model_probability')}) FILTER (abs(actual - line) > 1e-9) AS b, sqrt(avg(pow(actual - projection, 2))) AS rmse FROM scored GROUP BY 1, 2, 3)
      SELECT market, season, week, rows, n AS non_push_rows, {r6('CASE WHEN n >= 30 THEN ll END')} AS log_loss, {r6('CASE WHEN n >= 30 THEN b END')} AS brier, {r6('rmse')} AS rmse,
        {r6('1.96e0 * sqrt(CASE WHEN n >= 30 THEN b END / n)')} AS margin FROM a""",
    "edge_monotonicity": f"""WITH {SCORED_SQL}, e AS (SELECT *, model_probability - market_probability AS edge FROM scored),
      n AS (SELECT *, ntile(5) OVER (ORDER BY edge, l_orderkey, actual, line, model_probability, outcome, week, season) AS bin FROM e),
      b AS (SELECT CAST(bin AS INT) AS bin, count(*) AS count, avg(edge) AS mean_edge, avg(outcome) AS observed_rate FROM n GROUP BY 1),
      l AS (SELECT *, observed_rate - lag(observed_rate) OVER (ORDER BY bin) AS step FROM b)
      SELECT bin, count, {r6('mean_edge')} AS mean_edge, {r6('observed_rate')} AS observed_rate, (SELECT min(step) >= 0 FROM l) AS observed_rate_nondecreasing FROM l""",
    "calibrated_probabilities": f"""WITH RECURSIVE {SCORED_SQL}, {_FIT_SQL} SELECT market, {r6('icpt')} AS intercept, {r6('slope')} AS slope,
      {r6('const')} AS "constant", CAST(n AS BIGINT) AS rows FROM fit""",
    "promotion_gates": f"{_GATES_SQL} SELECT * FROM g",
    "gate_verdict": f"{_GATES_SQL} SELECT count(*) FILTER (passed) AS gates_passed, count(*) AS gates, CASE WHEN bool_and(passed) THEN 'PROMOTE' ELSE 'PASS_ONLY' END AS verdict FROM g",
    "ablation_deltas": f"""WITH {SCORED_SQL}, r AS (SELECT 'baseline' AS role, market_probability AS p, outcome AS y FROM scored UNION ALL SELECT 'candidate', model_probability, outcome FROM scored),
      b AS (SELECT role, {_BIN.format(p='p')} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS r, sum(pow(p - y, 2)) AS sb, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS sl FROM r GROUP BY 1, 2),
      s AS (SELECT role, sum(sb) / sum(n) AS brier, sum(sl) / sum(n) AS log_loss, sum(n * abs(mp - r)) / sum(n) AS calibration_error, CAST(sum(n) AS BIGINT) AS rows FROM b GROUP BY 1)
      SELECT c.rows, {', '.join(f"{r6(f'b.{m}')} AS baseline_{m}, {r6(f'c.{m}')} AS candidate_{m}, {r6(f'c.{m} - b.{m}')} AS {m}_delta" for m in ('brier', 'log_loss', 'calibration_error'))}
      FROM s c JOIN s b ON c.role = 'candidate' AND b.role = 'baseline'""",
    "version_comparison": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'spreads' ELSE 'totals' END AS market, CASE WHEN o_orderpriority < '3' THEN 1e0 ELSE 0e0 END AS y,
        0.3e0 + (o_custkey % 40) / 100e0 AS p, 0.35e0 + (o_custkey % 30) / 100e0 AS q, o_orderstatus, o_orderpriority FROM orders),
      c AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW'), b AS (SELECT * FROM o WHERE o_orderstatus <> 'P'),
      j AS (SELECT market, c.y, c.p, b.q, c.o_orderkey IS NOT NULL AS ic, b.o_orderkey IS NOT NULL AS ib FROM c FULL JOIN b USING (o_orderkey, market))
      SELECT market, count(*) FILTER (ic AND ib) AS matched, count(*) FILTER (NOT ib) AS unmatched_candidate, count(*) FILTER (NOT ic) AS unmatched_baseline,
        {r6(f"avg({_brier('p', 'y')}) FILTER (ic AND ib)")} AS candidate_brier, {r6(f"avg({_brier('q', 'y')}) FILTER (ic AND ib)")} AS baseline_brier,
        {r6(f"avg({_ll('p', 'y')}) FILTER (ic AND ib)")} AS candidate_log_loss, {r6(f"avg({_ll('q', 'y')}) FILTER (ic AND ib)")} AS baseline_log_loss FROM j GROUP BY 1""",
    "market_weights": f"""WITH {SCORED_SQL} SELECT market, season, {r6('CASE WHEN sum(pow(projection - line, 2)) <= 1e-12 THEN 0 ELSE greatest(0, least(1, sum((projection - line) * (actual - line)) / sum(pow(projection - line, 2)))) END')} AS market_weight FROM scored GROUP BY 1, 2""",
    "standardized_fold": f"""WITH {SCORED_SQL}, s AS (SELECT avg(projection) AS m, stddev_pop(projection) AS sd FROM scored WHERE season < 1999)
      SELECT market, season, {r6('avg((projection - m) / sd)')} AS mean_z, {r6('max((projection - m) / sd)')} AS max_z FROM scored, s WHERE season >= 1999 GROUP BY 1, 2""",
}
