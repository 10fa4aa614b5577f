import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.catalog import ledgers
from asofspark.catalog import models as md
from asofspark.operators import bootstrap as bs
from asofspark.operators import calibrate as cal
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators import rank as rk
from asofspark.operators import regression as rg
from asofspark.operators import scan
from asofspark.operators import temporal as tmp
from asofspark.operators import trees as tr
from asofspark.plans import selection as sel
from asofspark.plans import training as trn

FEATURES = ["x1", "x2"]
KEYS = ["market", "season"]


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(7)
    n = 400
    season = np.repeat([2020, 2021, 2022, 2023], n // 4)
    x = rng.normal(5.0, 2.0, size=(n, 2))
    line = np.round(rng.normal(0, 6, n) * 2) / 2
    target = np.round(line + 0.8 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 6, n))
    return season, x, line, target


@pytest.fixture(scope="module")
def rows(spark, matrix):
    season, x, line, target = matrix
    data = [
        (f"g{i}", m, int(season[i]), 1.0, 0.5, float(x[i, 0]), float(x[i, 1]), float(target[i]), float(line[i]), 0.5)
        for i in range(len(season))
        for m in ("spreads", "totals")
    ]
    return spark.createDataFrame(data, "game_id string, market string, season int, half_life double, prior_strength double, x1 double, x2 double, target double, line double, market_probability double").cache()


def sklearn_style(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - w @ mean, w


def test_walk_forward_equals_direct_ridge(rows, matrix):
    season, x, line, target = matrix
    oof, coefs = rg.out_of_fold(rows, KEYS, FEATURES, (0.1, 100.0), min_train=100)
    got = {(r["game_id"], r["alpha"]): r["raw"] for r in oof.filter("market = 'spreads'").collect()}
    assert {int(k[0][1:]) for k in got} == set(np.flatnonzero(season > 2020))  # the first season is never scored
    for s in (2021, 2023):
        for alpha in (0.1, 100.0):
            b0, w = sklearn_style(x[season < s], target[season < s], alpha)
            for i in np.flatnonzero(season == s)[:10]:
                assert got[(f"g{i}", alpha)] == pytest.approx(b0 + x[i] @ w, abs=1e-8)


def test_residual_target_subset_and_constant_feature(rows, matrix):
    season, x, line, target = matrix
    fixed = rows.withColumn("x2", F.lit(3.0))
    train = rg.training_blocks(rg.gram_blocks(fixed, KEYS, FEATURES), KEYS)
    out = rg.solve_folds(train, KEYS, FEATURES, (1.0,), {"one": ["x1"], "both": FEATURES}, residual_target=True)
    got = {r["feature_set"]: r for r in out.filter("market = 'spreads' AND season = 2023").collect()}
    m = season < 2023
    b0, w = sklearn_style(x[m][:, :1], (target - line)[m], 1.0)
    for name in ("one", "both"):
        assert got[name]["coef"][0] == pytest.approx(w[0], abs=1e-9) and got[name]["intercept"] == pytest.approx(b0, abs=1e-7)
        assert got[name]["coef"][1] == 0.0
    a = b0 + x[m][:, 0] * w[0]
    r = (target - line)[m]
    assert got["one"]["train_weight"] == pytest.approx(np.clip(a @ r / (a @ a), 0, 1), abs=1e-9)


def test_moments_combine_without_cancellation(spark):
    """Mean 1e6, standard deviation 1: raw sums of squares would lose all digits that count."""
    rng = np.random.default_rng(11)
    x = 1e6 + rng.normal(0, 1, (900, 2))
    y = 3.0 * (x[:, 0] - 1e6) - (x[:, 1] - 1e6) + rng.normal(0, 0.5, 900)
    season = np.repeat([1, 2, 3], 300)
    rows = [("spreads", int(s), float(a), float(b), float(t), 0.0) for s, (a, b), t in zip(season, x, y, strict=True)]
    df = spark.createDataFrame(rows, "market string, season int, x1 double, x2 double, target double, line double").repartition(7)
    train = rg.training_blocks(rg.gram_blocks(df, KEYS, FEATURES), KEYS)
    got = {r["season"]: r for r in rg.solve_folds(train, KEYS, FEATURES, (1.0,)).collect()}
    assert set(got) == {2, 3}
    for s in (2, 3):
        b0, w = sklearn_style(x[season < s], y[season < s], 1.0)
        assert got[s]["coef"] == pytest.approx(w.tolist(), rel=1e-8)
        assert got[s]["intercept"] + 1e6 * sum(got[s]["coef"]) == pytest.approx(b0 + 1e6 * w.sum(), abs=1e-6)
    direct = rg.Moments.of(x)
    halves = rg.Moments.of(x[:100]) + rg.Moments.of(x[100:])
    assert np.allclose(direct.products, halves.products, rtol=1e-9, atol=1e-6)
    assert np.allclose(rg.Moments.unpacked(direct.packed()).products, direct.products)


def test_market_weight_of_a_perfect_adjustment_is_one(spark):
    df = spark.createDataFrame([(1.0, 4.0, 3.0), (-2.0, 0.0, 2.0)], "d double, y double, m double")
    assert df.agg(rg.market_weight(F.col("d"), F.col("y") - F.col("m"))).head()[0] == pytest.approx(1.0)
    assert df.agg(rg.market_weight(F.lit(0.0), F.col("y") - F.col("m"))).head()[0] == 0.0


def brute(actual, proj, values, keys, absolute, p, line):
    """Direct evaluation of the shrunk empirical distribution."""
    signed = [s * k for k in keys for s in (-1, 1)]

    def single(mask):
        a, r = actual[mask], (actual - proj)[mask]
        mass = {k: np.mean(np.isclose(a, k)) for k in signed if np.isclose(a, k).any()}
        plain = r[~np.isin(a, signed)] if signed else r
        if plain.size == 0:
            plain, mass = r, {}
        c = max(0.0, 1 - sum(mass.values()))
        sim = p + plain
        w, e, lo = c * np.mean(sim > line), c * np.mean(np.isclose(sim, line)), c * np.mean(sim < line)
        w += sum(m for k, m in mass.items() if k > line)
        e += sum(m for k, m in mass.items() if k == line)
        lo += sum(m for k, m in mass.items() if k < line)
        return np.array([w, e, lo]) / (w + e + lo)

    v = np.abs(values) if absolute else values
    edges = np.unique(np.quantile(v, [1 / 3, 2 / 3]))
    bins = np.digitize(v, edges, right=True)
    here = int(np.digitize([abs(line) if absolute else line], edges, right=True)[0])
    whole = single(np.ones(len(actual), bool))
    n = int((bins == here).sum())
    if n < 30:
        return whole
    share = n / (n + 200)
    return share * single(bins == here) + (1 - share) * whole


def test_distribution_equals_direct_evaluation(rows, matrix):
    season, x, line, target = matrix
    final = line + 0.25 * np.round(x[:, 0])
    placed = rows.withColumn("final", F.col("line") + 0.25 * F.round("x1"))
    model = ds.fit_distribution(placed, ["market"])
    out = ds.score_distribution(model, placed.filter("season = 2023"), ["game_id"]).collect()
    assert len(out) == 200
    for r in out[::7]:
        i = int(r["game_id"][1:])
        spread = r["market"] == "spreads"
        want = brute(target, final, line, (3, 6, 7, 10, 14) if spread else (), spread, final[i], line[i])
        assert np.allclose([r["p_win"], r["p_push"], r["p_loss"]], want, atol=1e-9)
        assert r["p_win"] + r["p_push"] + r["p_loss"] == pytest.approx(1.0)


def test_key_number_mass_shows_as_push(spark):
    values = [3.0] * 20 + [7.0] * 10 + list(np.linspace(-20.3, 20.4, 70))
    df = spark.createDataFrame([("spreads", f"g{i}", float(v), 0.0, 3.0) for i, v in enumerate(values)], "market string, game_id string, target double, final double, line double")
    model = ds.fit_distribution(df, ["market"])
    out = ds.score_distribution(model, df.limit(1), ["game_id"]).head()
    assert out["p_push"] >= 0.20


def test_closing_anchor_prices_the_close_fairly(rows):
    model = ds.fit_distribution(rows.withColumn("final", F.col("line")), ["market"])
    q = rows.filter("season = 2023").select("game_id", "market", F.col("line").alias("closing_line"), F.lit(0.57).alias("closing_probability"), F.col("line").alias("decision_line"))
    out = ds.closing_anchored(model, q, ["game_id"]).collect()
    for r in out:
        assert r["closing_win"] / (r["closing_win"] + r["closing_loss"]) == pytest.approx(0.57, abs=1e-9)


def test_calibrator_equals_newton(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.2, 0.8, 600)
    y = (rng.uniform(size=600) < p**1.3).astype(float)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(p, y)] + [("one", 0.4, 1.0)], "g string, p double, y double")
    fits = {r["g"]: r for r in cal.fit_by_group(df, "g", "p", "y").collect()}
    x = np.column_stack([np.ones(600), np.log(p / (1 - p))])
    b = np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (mu * (1 - mu))[:, None]) + np.diag([0.0, 1e-6])
        b -= np.linalg.solve(h, x.T @ (mu - y) + np.array([0.0, 1e-6 * b[1]]))
    assert fits["a"]["intercept"] == pytest.approx(b[0], abs=1e-5) and fits["a"]["slope"] == pytest.approx(b[1], abs=1e-5)
    assert fits["one"]["slope"] is None and fits["one"]["constant"] == 1.0


def test_bootstrap_is_repeatable_and_near_the_direct_one(spark):
    rng = np.random.default_rng(5)
    n = 400
    p, q = rng.uniform(0.3, 0.7, n), np.full(n, 0.5)
    y = (rng.uniform(size=n) < p).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(p, q, y))], "id long, p double, q double, y double")
    one = {r["metric"]: r for r in bs.paired_scores(df, "id", "y", "p", "q").collect()}
    two = {r["metric"]: r for r in bs.paired_scores(df.repartition(3), "id", "y", "p", "q").collect()}
    for m in ("lower_95", "median", "upper_95"):
        assert one["brier"][m] == pytest.approx(two["brier"][m], abs=1e-12)
    d = (p - y) ** 2 - (q - y) ** 2
    direct = np.quantile(d[rng.integers(0, n, (4000, n))].mean(1), [0.025, 0.975])
    assert np.allclose([one["brier"]["lower_95"], one["brier"]["upper_95"]], direct, atol=0.003)


def test_season_bootstrap_widens_with_season_effects(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{s}-{i}", s, float(rng.normal()), float(2.0 * (s % 2)), 0.0) for s in range(2010, 2020) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, season int, actual double, final double, line double")
    wide = bs.rmse_difference(df, "id", "actual", "final", "line", "season").head()
    narrow = bs.interval(bs.replicate_sums(df, "id", {"ef": "pow(actual - final, 2)", "el": "pow(actual - line, 2)"}), {"d": "sqrt(ef / weight) - sqrt(el / weight)"}).head()
    assert wide["upper_95"] - wide["lower_95"] > 2 * (narrow["upper_95"] - narrow["lower_95"])


def test_scans_match_numpy(spark):
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", float(a)) for i, a in enumerate(v)], "id int, k string, v double")
    q = scan.exact_quantiles(df, "v", [1 / 3, 2 / 3, 0.975]).head()
    assert np.allclose([q["q0"], q["q1"], q["q2"]], np.quantile(v, [1 / 3, 2 / 3, 0.975]))
    bins = scan.equal_count_bins(df.limit(13), [F.col("v"), F.col("id")], 5).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in bins] == [3, 3, 3, 2, 2]
    few = scan.equal_count_bins(df.limit(3), [F.col("v"), F.col("id")], 5).orderBy("bin").collect()
    assert [r["bin"] for r in few] == [1, 2, 3]
    numbered = scan.row_numbers(df, [F.col("v"), F.col("id")], keys=["k"]).filter("k = 'hot'").orderBy("v", "id").collect()
    assert [r["row_number"] for r in numbered] == list(range(1, len(numbered) + 1))


def test_gates_fail_on_an_undefined_slope(spark):
    df = spark.createDataFrame([("spreads", 0.2, 0.25, 0.6, 0.7, 0.0, 1.0), ("totals", 0.25, 0.25, 0.6, 0.7, None, None)], "market string, model_brier double, market_brier double, model_log_loss double, market_log_loss double, intercept double, slope double")
    gates = {r["gate"]: r["passed"] for r in ev.promotion_gates(df).collect()}
    assert gates == {
        "spread_brier_beats_market": True, "spread_log_loss_beats_market": True, "spread_calibration_acceptable": True,
        "total_brier_beats_market": False, "total_log_loss_beats_market": True, "total_calibration_acceptable": False,
    }
    assert ev.verdict(ev.promotion_gates(df)).head()["verdict"] == "PASS_ONLY"


def test_probability_of_one_falls_in_bin_ten(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.95, 1.0)], "p double, y double")
    assert {r["bin"]: r["count"] for r in ev.reliability(df, [], "p", "y").collect()} == {10: 2, 1: 1}


def test_market_only_wins_ties(spark):
    df = spark.createDataFrame([("spreads", "ridge", 0.69, 0.25, 12.0), ("spreads", "market_only", 0.69, 0.25, 12.0), ("totals", "tree", 0.68, 0.25, 12.0), ("totals", "market_only", 0.69, 0.25, 12.0)], "market string, family string, log_loss double, brier double, rmse double")
    assert {r["market"]: r["family"] for r in sel.choose_family(df).collect()} == {"spreads": "market_only", "totals": "tree"}


def test_feature_sets_have_all_combinations():
    sets = sel.feature_set_grid({"a": ["x"], "b": ["y"], "c": ["z"], "d": ["w"], "e": ["v"]}, ["a"], ["b", "c", "d", "e"])
    assert len(sets) == 16 and sets["a"] == ["x"] and sets["a+b+c"] == ["x", "y", "z"]


def test_joint_selection_prefers_the_useful_feature(rows):
    coefs = sel.candidate_folds(rows, FEATURES, {"first": ["x1"], "both": FEATURES}, (1.0,))
    oof = sel.candidate_probabilities(rows, FEATURES, coefs).cache()
    assert oof.filter("season = 2020").count() == 0 and oof.filter("probability < 0 OR probability > 1").count() == 0
    best = {r["market"]: r for r in sel.best_candidates(sel.candidate_scores(oof)).collect()}
    assert set(best) == {"spreads", "totals"} and best["spreads"]["rows"] == 300


def test_grid_scores_in_a_task_equal_the_distributed_scan(rows):
    wide = rows.unionByName(rows.withColumn("half_life", F.lit(4.0)).withColumn("x1", F.col("x1") * F.col("x2")).filter("season > 2020 OR x2 > 5.5"))
    wide = wide.withColumn("target", F.when(F.col("x2") > 7, F.lit(3.0)).otherwise(F.col("target")))  # some on a key number
    coefs = sel.candidate_folds(wide, FEATURES, {"first": ["x1"], "both": FEATURES}, (0.1, 100.0)).cache()
    key = lambda r: tuple(r[c] for c in sel.CANDIDATE)
    held = {key(r): r for r in sel.grid_scores(wide, FEATURES, coefs).collect()}
    spread = {key(r): r for r in sel.grid_scores(wide, FEATURES, coefs, rows_a_task=10).collect()}
    assert len(held) == 2 * 2 * 2 * 2 and set(held) == set(spread)
    for k, a in held.items():
        b = spread[k]
        assert (a["rows"], a["non_push_rows"], a["n_features"]) == (b["rows"], b["non_push_rows"], b["n_features"])
        assert [a[c] for c in ("log_loss", "brier", "rmse")] == pytest.approx([b[c] for c in ("log_loss", "brier", "rmse")], abs=1e-12)


def test_folds_with_few_rows_have_the_same_scores_both_ways(rows):
    few = rows.filter("CAST(substr(game_id, 2) AS INT) % 100 < 20")  # 20 rows a season: the first fold has no distribution
    coefs = sel.candidate_folds(few, FEATURES, {"both": FEATURES}, (1.0,), min_train=10).cache()
    cols = ["market", "rows", "non_push_rows", "log_loss", "brier", "rmse"]
    held, spread = (
        [tuple(r) for r in sel.grid_scores(few, FEATURES, coefs, rows_a_task=n).select(*cols).orderBy("market").collect()] for n in (1000, 10)
    )
    assert len(held) == 2 and [a[:3] for a in held] == [b[:3] for b in spread]
    assert [x for a in held for x in a[3:]] == pytest.approx([x for b in spread for x in b[3:]], abs=1e-12)


def test_joint_selection_tries_every_configuration(spark, monkeypatch):
    names = list(md.base_features())
    rng = np.random.default_rng(3)
    season = np.repeat([2020, 2021, 2022], 80)
    x = rng.normal(0.0, 1.0, size=(len(season), len(names)))
    target = np.round(6.0 * x[:, 0] + rng.normal(0, 1, len(season))) + 0.5
    asked = []

    def matrix(spark, sf_dir, half_lives=tmp.HALF_LIFE_GRID, strengths=tmp.PRIOR_STRENGTH_GRID):
        data = []
        for h in half_lives:
            for s in strengths:
                asked.append((h, s))
                told = x if (h, s) == (4.0, 0.25) else rng.normal(0.0, 1.0, x.shape)  # one configuration alone knows
                data += [(i, int(season[i]), h, s, *map(float, told[i]), float(target[i]), float(target[i]), 0.0, 0.0, 0.5, 0.5) for i in range(len(season))]
        cols = ["half_life", "prior_strength", *names, "target_margin", "target_total", "spread_line", "total_line", "market_spread_probability", "market_total_probability"]
        return spark.createDataFrame(data, "game_id int, season int, " + ", ".join(f"{c} double" for c in cols))

    monkeypatch.setattr(md, "matrix", matrix)
    got = {r["market"]: (r["half_life"], r["prior_strength"]) for r in ledgers.joint_selection(spark, "").collect()}
    assert len(asked) == 12 and got == {"spreads": (4.0, 0.25), "totals": (4.0, 0.25)}


def test_training_produces_complete_tables(rows):
    t = trn.train(rows, FEATURES, residual_target=True)
    assert t.coefs.count() == 2 and t.calibration.count() == 2
    final = t.selection.filter("season IS NULL").collect()
    assert {r["market"] for r in final} == {"spreads", "totals"} and all(0 <= r["market_weight"] <= 1 for r in final)
    nested = trn.nested_report(t.oof, t.selection, True)
    assert nested.filter("abs(p_win + p_push + p_loss - 1) > 1e-9").count() == 0


def test_attribution_and_drift(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 0.0, -1.0)], "id int, a double, b double")
    out = rk.attribution(df, ["a", "b"], {"a": 1.0, "b": 0.5}, {"a": 0.0, "b": 1.0}, ["id"], top=1).orderBy("id").collect()
    assert [(r["feature"], r["projection_contribution"]) for r in out] == [("a", 2.0), ("b", -1.0)]
    prof = spark.createDataFrame([("a", 0.0, 2.0, -1.0, 1.0), ("b", 0.0, 0.0, 0.0, 4.0)], "feature string, mean double, std double, min double, max double")
    drift = {r["id"]: r for r in rk.feature_drift(df, ["a", "b"], prof, ["id"]).collect()}
    assert drift[1]["feature_drift_max_abs_z"] == 5.0 and drift[1]["feature_outside_training_range"] == 2
    assert drift[2]["feature_outside_training_range"] == 1


def test_poisson_draws_have_their_mean_and_variance():
    draw, ids, groups = bs._Draws(), np.arange(2000) * 7919 + 13, np.arange(25)
    for mean in (1, 3, 20, 5000):
        got = draw(ids, groups, np.full((2000, 100), mean, dtype=np.int64))
        assert abs(got.mean() - mean) < 0.02 * mean**0.5 + 0.01 * mean**0.5 and abs(got.var() - mean) < 0.05 * mean


def test_merged_rows_draw_like_single_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(y), 0.6 if y else 0.45, 0.5) for i, y in enumerate(rng.integers(0, 2, 500))]  # two different tuples
    df = spark.createDataFrame(rows, "id long, y double, p double, q double")
    single = {r["metric"]: r for r in bs.paired_scores(df, "id", "y", "p", "q", samples=3000).collect()}
    merged = {r["metric"]: r for r in bs.paired_scores(df, None, "y", "p", "q", samples=3000).collect()}
    for m in ("brier", "log_loss"):
        width = single[m]["upper_95"] - single[m]["lower_95"]
        assert merged[m]["upper_95"] - merged[m]["lower_95"] == pytest.approx(width, rel=0.1)


def test_drivers_of_any_model_and_disagreement(spark):
    nodes = [(0, 1.5, 1, 2, 0.0), (-1, 0.0, -1, -1, 3.0), (1, 0.0, 3, 4, 0.0), (-1, 0.0, -1, -1, -1.0), (-1, 0.0, -1, -1, 7.0)]
    rows = spark.createDataFrame([(1, 2.0, 5.0), (2, 1.0, -1.0)], "id int, a double, b double")
    model = spark.createDataFrame([(0.0, 2, [nodes])], f"base double, depth int, trees array<{tr._NODE}>")
    rows = rows.withColumn("m", model.select(F.struct("base", "depth", "trees")).scalar())
    tree = lambda x: tr.ensemble(F.col("m.base"), F.col("m.trees"), F.col("m.depth"), x)
    line = lambda x: rk.linear(x, F.lit(1.0), F.array(F.lit(2.0), F.lit(-1.0)))
    means = F.array(F.lit(1.0), F.lit(0.0))
    got = [(r.id, r.driver_rank, r.feature, r.projection_contribution) for r in rk.model_attribution(rows, ["a", "b"], means, tree, ["id"]).collect()]
    # row 1 lies in leaf 7; with a = 1 it falls to 3, with b = 0 to -1
    assert sorted(got) == [(1, 1, "b", 8.0), (1, 2, "a", 4.0), (2, 1, "a", 0.0), (2, 2, "b", 0.0)]
    blend = rk.model_attribution(rows, ["a", "b"], means, lambda x: tr.blend(line(x), tree(x), "blend_50"), ["id"], top=1)
    assert sorted((r.id, r.feature, r.projection_contribution) for r in blend.collect()) == [(1, "a", 3.0), (2, "b", 0.5)]
    x = F.array("a", "b")
    told = rows.select(line(x).alias("p"), tree(x).alias("q")).select(rk.component_disagreement("p", "q").alias("d"))
    assert sorted(r.d for r in told.collect()) == [1.0, 7.0]


def test_every_family_is_scored_under_the_chosen_candidate(rows):
    sets = {"both": FEATURES}
    chosen = rows.sparkSession.createDataFrame(
        [(m, 1.0, 0.5, "both", 1.0) for m in ("spreads", "totals")], "market string, half_life double, prior_strength double, feature_set string, alpha double"
    )
    out = sel.family_probabilities(rows, FEATURES, chosen, sets, settings=tr.Boosting(rounds=5, min_leaf=10)).cache()
    assert {(r["market"], r["family"]): r["n"] for r in out.groupBy("market", "family").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (m, f): 300 for m in ("spreads", "totals") for f in tr.BLENDS
    }
    assert out.filter("season <> fold OR probability < 0 OR probability > 1").count() == 0
    ridge = sel.candidate_probabilities(rows, FEATURES, sel.candidate_folds(rows, FEATURES, sets, (1.0,)))
    both = ridge.select("game_id", "market", F.col("probability").alias("p")).join(out.filter("family = 'ridge'"), ["game_id", "market"])
    assert both.count() == 600 and both.filter("abs(p - probability) > 1e-9").count() == 0
