"""Scores, reliability, gates and verdicts as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.fixed_values import PROBABILITY_CLIP
from asofspark.functions.scalars import clip_probability, first_reason
from asofspark.operators.calibrate import fit_by_group
from asofspark.operators.scan import equal_count_bins


def brier(p: str | Column, y: str | Column, clip: bool = True) -> Column:
    q = clip_probability(p) if clip else (F.col(p) if isinstance(p, str) else p)
    return F.pow(q - (F.col(y) if isinstance(y, str) else y), F.lit(2))


def log_loss(p: str | Column, y: str | Column, eps: float = PROBABILITY_CLIP) -> Column:
    q = clip_probability(p, eps)
    o = F.col(y) if isinstance(y, str) else y
    return -(o * F.ln(q) + (F.lit(1.0) - o) * F.ln(F.lit(1.0) - q))


def rmse(actual: str, projection: str) -> Column:
    e = F.col(actual) - F.col(projection)
    return F.sqrt(F.avg(e * e))


def mae(actual: str, projection: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(projection)))


def projection_metrics(df: DataFrame, keys: list[str], actual: str, projections: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[m for p in projections for m in (rmse(actual, p).alias(f"{p}_rmse"), mae(actual, p).alias(f"{p}_mae"))],
    )


def probability_metrics(df: DataFrame, keys: list[str], outcome: str, probabilities: list[str], clip: bool = True) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            m
            for p in probabilities
            for m in (F.avg(brier(p, outcome, clip)).alias(f"{p}_brier"), F.avg(log_loss(p, outcome)).alias(f"{p}_log_loss"))
        ],
    )


def not_push(actual: str, line: str, tolerance: float | None = None) -> Column:
    """Pushes excluded: exact equality in training, a tolerance in settlement."""
    gap = F.abs(F.col(actual) - F.col(line))
    return F.col(actual) != F.col(line) if tolerance is None else gap > tolerance


def reliability_bin(p: str | Column) -> Column:
    q = F.col(p) if isinstance(p, str) else p
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))
    return (F.least(F.floor(inside * 10), F.lit(9)) + 1).cast("int")


def reliability(df: DataFrame, keys: list[str], probability: str, outcome: str) -> DataFrame:
    """Ten bins, numbered from 1; a probability of one falls in bin 10."""
    return df.groupBy(*keys, reliability_bin(probability).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(probability).alias("mean_probability"), F.avg(outcome).alias("observed_rate")
    )


def calibration_error(df: DataFrame, keys: list[str], probability: str, outcome: str) -> DataFrame:
    """Σ count/N · |mean probability - observed rate| over the bins."""
    bins = reliability(df, keys, probability, outcome)
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
    return bins.groupBy(*keys).agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("calibration_error"))


def probability_bundle(
    df: DataFrame, keys: list[str], probability: str, outcome: str, actual: str, projection: str, line: str, minimum: int = 30,
) -> DataFrame:
    """Log-loss and Brier over non-pushes (null below the minimum), RMSE over all rows."""
    live = not_push(actual, line, 1e-9)
    n = F.count_if(live)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        n.alias("non_push_rows"),
        F.when(n >= minimum, F.avg(F.when(live, log_loss(probability, outcome)))).alias("log_loss"),
        F.when(n >= minimum, F.avg(F.when(live, brier(probability, outcome)))).alias("brier"),
        rmse(actual, projection).alias("rmse"),
    )


def edge_monotonicity(df: DataFrame, model: str, market: str, outcome: str, order: list[str], bins: int = 5) -> DataFrame:
    """Observed rate by equal-count edge bin and whether it never falls.

    ``order`` makes the order of equal edges definite.
    """
    edged = df.withColumn("edge", F.col(model) - F.col(market))
    rows = equal_count_bins(edged, [F.col("edge"), *[F.col(c) for c in order]], bins)
    table = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("edge").alias("mean_edge"), F.avg(outcome).alias("observed_rate")
    )
    step = F.col("observed_rate") - F.lag("observed_rate").over(Window.orderBy("bin"))  # a handful of bins
    stepped = table.withColumn("_step", step)
    return stepped.withColumn(
        "observed_rate_nondecreasing", F.coalesce(F.min("_step").over(Window.partitionBy()) >= 0, F.lit(True))
    ).drop("_step")


def probability_margin(brier_col: str | Column, n: str | Column) -> Column:
    b = F.col(brier_col) if isinstance(brier_col, str) else brier_col
    m = F.col(n) if isinstance(n, str) else n
    return F.lit(1.96) * F.sqrt(b / m)


def promotion_gates(metrics: DataFrame) -> DataFrame:
    """Six gates from one row per market.

    metrics: market, model_brier, market_brier, model_log_loss,
    market_log_loss, intercept, slope. An undefined slope fails.
    """
    ok = F.coalesce((F.abs("intercept") <= 0.20) & F.col("slope").between(0.50, 1.50), F.lit(False))
    short = F.when(F.col("market") == "spreads", F.lit("spread")).otherwise(F.lit("total"))

    def gate(suffix: str, cond: Column) -> Column:
        return F.struct(F.concat(short, F.lit(suffix)).alias("gate"), F.coalesce(cond, F.lit(False)).alias("passed"))

    gates = F.array(
        gate("_brier_beats_market", F.col("model_brier") < F.col("market_brier")),
        gate("_log_loss_beats_market", F.col("model_log_loss") < F.col("market_log_loss")),
        gate("_calibration_acceptable", ok),
    )
    return metrics.select(F.inline(gates))


def verdict(gates: DataFrame, passed: str = "PROMOTE", failed: str = "PASS_ONLY") -> DataFrame:
    return gates.agg(
        F.count_if("passed").alias("gates_passed"),
        F.count(F.lit(1)).alias("gates"),
        F.when(F.bool_and("passed"), F.lit(passed)).otherwise(F.lit(failed)).alias("verdict"),
    )


def matched_comparison(
    candidate: DataFrame, baseline: DataFrame, on: list[str], outcome: str, probability: str, prefix: tuple[str, str] = ("candidate", "baseline"),
) -> DataFrame:
    """Two versions on the contracts both have, with the unmatched counts.

    One full join yields matched scores and both unmatched counts per market.
    """
    c = candidate.select(*on, F.col(outcome).alias("_y"), F.col(probability).alias("_pc"), F.lit(True).alias("_in_c"))
    b = baseline.select(*on, F.col(outcome).alias("_yb"), F.col(probability).alias("_pb"), F.lit(True).alias("_in_b"))
    both = c.join(b, on, "full")
    hit = F.col("_in_c").isNotNull() & F.col("_in_b").isNotNull()
    return both.groupBy("market").agg(
        F.count_if(hit).alias("matched"),
        F.count_if(F.col("_in_b").isNull()).alias(f"unmatched_{prefix[0]}"),
        F.count_if(F.col("_in_c").isNull()).alias(f"unmatched_{prefix[1]}"),
        F.avg(F.when(hit, brier("_pc", "_y"))).alias(f"{prefix[0]}_brier"),
        F.avg(F.when(hit, brier("_pb", "_y"))).alias(f"{prefix[1]}_brier"),
        F.avg(F.when(hit, log_loss("_pc", "_y"))).alias(f"{prefix[0]}_log_loss"),
        F.avg(F.when(hit, log_loss("_pb", "_y"))).alias(f"{prefix[1]}_log_loss"),
    )


def ablation_deltas(df: DataFrame, outcome: str, baseline: str, candidate: str) -> DataFrame:
    """Candidate minus baseline Brier, log-loss and calibration error, unclipped.

    Both reliability tables come from one pass, as rows per role.
    """
    roles = df.select(
        F.col(outcome).alias("y"),
        F.inline(F.array(
            F.struct(F.lit("baseline").alias("role"), F.col(baseline).alias("p")),
            F.struct(F.lit("candidate").alias("role"), F.col(candidate).alias("p")),
        )),
    )
    bins = roles.groupBy("role", reliability_bin("p").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"),
        F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("sb"),
        F.sum(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("sl"),
    )
    scores = bins.groupBy("role").agg(
        (F.sum("sb") / F.sum("n")).alias("brier"),
        (F.sum("sl") / F.sum("n")).alias("log_loss"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("calibration_error"),
        F.sum("n").alias("rows"),
    )
    def pick(role: str, m: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(m)))

    names = ("brier", "log_loss", "calibration_error")
    return scores.agg(
        F.max("rows").alias("rows"),
        *[pick(r, m).alias(f"{r}_{m}") for r in ("baseline", "candidate") for m in names],
        *[(pick("candidate", m) - pick("baseline", m)).alias(f"{m}_delta") for m in names],
    )


def ablation_acceptance(deltas: DataFrame, intervals: DataFrame) -> DataFrame:
    """Accept when all deltas improve and both intervals stay below zero.

    ``intervals`` has rows metric (brier, log_loss) and upper_95.
    """
    wide = intervals.agg(
        F.max(F.when(F.col("metric") == "brier", F.col("upper_95"))).alias("brier_upper"),
        F.max(F.when(F.col("metric") == "log_loss", F.col("upper_95"))).alias("log_loss_upper"),
    )
    return deltas.select("*", wide.select("brier_upper").scalar().alias("brier_upper"), wide.select("log_loss_upper").scalar().alias("log_loss_upper")).withColumn(
        "meets_research_acceptance",
        (F.col("brier_delta") < 0) & (F.col("log_loss_delta") < 0) & (F.col("brier_upper") < 0)
        & (F.col("log_loss_upper") < 0) & (F.col("calibration_error_delta") <= 0),
    )


def prospective_summary(evaluations: DataFrame, minimum: int, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Counts, scores, CLV means and readiness per market from the ledger."""
    live = F.col("eligible_non_push") == 1
    y = (F.col("result") == "WIN").cast("double")
    model, market = F.col("model_non_push_win_probability"), F.col("decision_market_probability")
    has = F.col("final_projection").isNotNull()
    return evaluations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated_games"),
        F.count_if(F.col("result") != "EXCLUDED").alias("canonical_contracts"),
        F.count_if(live).alias("eligible_non_push"),
        F.count_if(F.col("result") == "PUSH").alias("pushes"),
        F.count_if(F.col("result") == "EXCLUDED").alias("excluded"),
        F.avg(F.when(live, brier(model, y, clip=False))).alias("model_brier"),
        F.avg(F.when(live, brier(market, y, clip=False))).alias("market_brier"),
        F.avg(F.when(live, log_loss(model, y))).alias("model_log_loss"),
        F.avg(F.when(live, log_loss(market, y))).alias("market_log_loss"),
        F.sqrt(F.avg(F.when(has, F.pow("projection_error", F.lit(2))))).alias("projection_rmse"),
        F.avg(F.when(has, F.abs("projection_error"))).alias("projection_mae"),
        F.avg("line_clv").alias("mean_line_clv"),
        F.avg("decision_price_clv").alias("mean_price_clv"),
        F.avg("closing_contract_ev").alias("mean_closing_contract_ev"),
        F.count_if(F.col("clv_status") == "AVAILABLE").alias("clv_available"),
        F.count_if(F.col("clv_status") != "AVAILABLE").alias("clv_unavailable"),
        (F.count_if(live) >= minimum).alias("ready"),
    )


def summary_with_calibration(evaluations: DataFrame, minimum: int) -> DataFrame:
    """The summary per market with intercept and slope of outcome on logit(model probability), eligible rows only."""
    live = evaluations.filter(F.col("eligible_non_push") == 1).select(
        "market", F.col("model_non_push_win_probability").alias("_p"), (F.col("result") == "WIN").cast("double").alias("_y")
    )
    fits = fit_by_group(live, "market", "_p", "_y").select(
        "market", F.col("intercept").alias("calibration_intercept"), F.col("slope").alias("calibration_slope")
    )
    return prospective_summary(evaluations, minimum).join(fits, "market", "left")


def prospective_reliability(evaluations: DataFrame) -> DataFrame:
    """Ten reliability bins per market over the eligible rows."""
    live = evaluations.filter(F.col("eligible_non_push") == 1).withColumn("_y", (F.col("result") == "WIN").cast("double"))
    return reliability(live, ["market"], "model_non_push_win_probability", "_y")


def exclusion_counts(evaluations: DataFrame, reason: str = "exclusion_reason", keys: tuple[str, ...] = ("market",)) -> DataFrame:
    return evaluations.filter(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("rows"))


def coverage_by_week(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("week", "market").agg(
        F.count(F.lit(1)).alias("evaluations"), F.sum("eligible_non_push").alias("eligible_non_push")
    )


def readiness(games: DataFrame, evaluations: DataFrame, markets: list[str], minimum: int) -> DataFrame:
    """Ready, or the first reason to defer the formal test.

    The expected (game, market) grid is an explode of the markets over the
    finished games.
    """
    done = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    open_games = games.agg(F.count_if(~done).alias("n"))
    grid = games.select("game_id", F.explode(F.array(*[F.lit(m) for m in markets])).alias("market"))
    missing = grid.join(evaluations.select("game_id", "market"), ["game_id", "market"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    counts = evaluations.groupBy("market").agg(F.sum("eligible_non_push").alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m"))
    row = counts.select(
        open_games.scalar().alias("incomplete_results"),
        missing.scalar().alias("missing_evaluations"),
        F.when(F.col("m") == len(markets), F.coalesce("least", F.lit(0))).otherwise(0).alias("smallest_sample"),
    )
    return row.withColumn(
        "verdict",
        first_reason(
            (F.col("incomplete_results") > 0, "DEFERRED_INCOMPLETE_RESULTS"),
            (F.col("missing_evaluations") > 0, "DEFERRED_MISSING_EVALUATIONS"),
            (F.col("smallest_sample") < minimum, "DEFERRED_INSUFFICIENT_SAMPLE"),
            otherwise="READY",
        ),
    )


def final_weeks(games: DataFrame, through: Column | None = None, keys: tuple[str, ...] = ("season", "week")) -> DataFrame:
    """Weeks whose every game is final (and started by ``through``): evidence may be opened."""
    done = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    sealed = F.bool_and(done)
    if through is not None:
        sealed = sealed & (F.max("kickoff_dt") <= through)
    return games.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.count_if(done).alias("final_games"), sealed.alias("unsealed"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
