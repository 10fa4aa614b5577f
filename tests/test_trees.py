import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.operators import trees as tr

FEATURES = ["a", "b", "c"]
CFG = tr.Boosting(rounds=6, learning_rate=0.3, max_leaves=5, min_leaf=4, l2=2.0, max_bins=64)


def grown(x, y, cfg):
    """One tree, leaf by leaf, by trying every value of every feature on the rows themselves."""
    def best(rows):
        g, n = y[rows].sum(), len(rows)
        found = (0.0, None)
        for j in range(x.shape[1]):
            for v in np.unique(x[rows, j]):
                left = rows[x[rows, j] <= v]
                right = rows[x[rows, j] > v]
                if min(len(left), len(right)) >= cfg.min_leaf:
                    gain = y[left].sum() ** 2 / (len(left) + cfg.l2) + y[right].sum() ** 2 / (len(right) + cfg.l2) - g * g / (n + cfg.l2)
                    if gain > found[0] + 1e-9:
                        found = (gain, (left, right))
        return found

    leaves = [(rows := np.arange(len(y)), *best(rows))]
    while len(leaves) < cfg.max_leaves:
        i = max(range(len(leaves)), key=lambda k: leaves[k][1])
        if leaves[i][2] is None:
            break
        left, right = leaves.pop(i)[2]
        leaves += [(left, *best(left)), (right, *best(right))]
    out = np.zeros(len(y))
    for rows, *_ in leaves:
        out[rows] = cfg.learning_rate * y[rows].sum() / (len(rows) + cfg.l2)
    return out


def boosted(x, y, cfg):
    f = np.full(len(y), y.mean())
    for _ in range(cfg.rounds):
        f = f + grown(x, y - f, cfg)
    return f


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 240
    season = np.repeat([2020, 2021, 2022, 2023], n // 4)
    x = rng.integers(0, 12, (n, 3)).astype(float)  # few values, so that bins are values
    y = np.where(x[:, 0] > 5, 4.0, 0.0) + x[:, 1] * (x[:, 2] > 7) + rng.normal(0, 1, n)
    return season, x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    season, x, y = data
    out = [(i, m, int(s), *map(float, v), float(t if m == "spreads" else -2 * t)) for m in ("spreads", "totals") for i, (s, v, t) in enumerate(zip(season, x, y, strict=True))]
    out += [(900, "spreads", 2020, None, 1.0, 1.0, 1e6), (901, "spreads", 2020, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(out, "game_id int, market string, season int, a double, b double, c double, target double")


@pytest.mark.parametrize("rows_a_task,rounds_a_job", [(50_000, 100), (150, 4)])
def test_all_folds_equal_a_plain_booster(rows, data, monkeypatch, rows_a_task, rounds_a_job):
    season, x, y = data
    monkeypatch.setattr(tr, "ROWS_A_TASK", rows_a_task)
    monkeypatch.setattr(tr, "ROUNDS_A_JOB", rounds_a_job)
    model = tr.boost_folds(rows, ["market"], FEATURES, [2020, 2021, 2022, 2023], min_train=60, settings=CFG)
    found = {(r.market, r.season): r for r in model.collect()}
    assert set(found) == {(m, s) for m in ("spreads", "totals") for s in (2021, 2022, 2023)}  # no earlier rows, no model
    scored = tr.score_trees(rows.withColumnRenamed("season", "of"), model.filter("season = 2023"), ["market"], FEATURES).filter("of < 2023")
    for market, sign in (("spreads", 1.0), ("totals", -2.0)):
        train = season < 2023
        expected = boosted(x[train], sign * y[train], CFG)
        got = {r.game_id: r.tree_raw for r in scored.filter((F.col("market") == market) & (F.col("game_id") < 900)).collect()}
        assert np.allclose([got[i] for i in np.flatnonzero(train).tolist()], expected, atol=1e-9)
        r = found[market, 2023]
        assert r.n_train == 180 and len(r.trees) == CFG.rounds and all(sum(n.feature < 0 for n in t) <= CFG.max_leaves for t in r.trees)


def test_out_of_fold_rows_never_see_their_own_season(rows, data):
    season, x, y = data
    out = tr.tree_out_of_fold(rows, FEATURES, [2020, 2023], min_train=60, settings=CFG).collect()
    assert {r.season for r in out} == {2023} and len(out) == 120
    turned = rows.withColumn("target", F.when(F.col("season") == 2023, 0.0).otherwise(F.col("target")))
    again = tr.tree_out_of_fold(turned, FEATURES, [2023], min_train=60, settings=CFG)
    assert sorted((r.market, r.game_id, r.tree_raw) for r in out) == sorted((r.market, r.game_id, r.tree_raw) for r in again.collect())


def test_jvm_scores_equal_the_tables(spark):
    nodes = [(0, 1.5, 1, 2, 0.0), (-1, 0.0, -1, -1, 3.0), (1, 0.0, 3, 4, 0.0), (-1, 0.0, -1, -1, -1.0), (-1, 0.0, -1, -1, 7.0)]
    model = spark.createDataFrame([("m", 10.0, 2, [nodes, nodes[1:2]])], f"market string, base double, depth int, trees array<{tr._NODE}>")
    x = [(1.0, 0.0), (1.5, 9.0), (2.0, 0.0), (2.0, 0.1), (None, 5.0)]
    rows = spark.createDataFrame([(i, "m", *v) for i, v in enumerate(x)] + [(9, "other", 1.0, 1.0)], "i int, market string, a double, b double")
    got = {r.i: r.tree_raw for r in tr.score_trees(rows, model, ["market"], ["a", "b"]).collect()}
    assert got == {0: 16.0, 1: 16.0, 2: 12.0, 3: 20.0, 4: 16.0}


def test_blends():
    assert tr.BLENDS["blend_25"] == 0.25 and tr.BLENDS["ridge"] == 1.0


def test_an_unrolled_ensemble_equals_its_table_and_compiles(spark):
    from asofspark.operators import rank as rk

    nodes = [(0, 1.5, 1, 2, 0.0), (-1, 0.0, -1, -1, 3.0), (1, 0.0, 3, 4, 0.0), (-1, 0.0, -1, -1, -1.0), (-1, 0.0, -1, -1, 7.0)]
    x = [(1.0, 0.0), (1.5, 9.0), (2.0, 0.0), (2.0, 0.1), (None, 5.0), (float("nan"), None)]
    model = spark.createDataFrame([(10.0, 2, [nodes, nodes[1:2]])], f"base double, depth int, trees array<{tr._NODE}>")
    rows = spark.createDataFrame(x, "a double, b double").withColumn("m", model.select(F.struct("base", "depth", "trees")).scalar())
    plain = lambda x: tr.unrolled(10.0, [nodes, nodes[1:2]], x)
    table = lambda x: tr.ensemble(F.col("m.base"), F.col("m.trees"), F.col("m.depth"), x)
    means = F.array(F.lit(1.0), F.lit(0.0))
    drivers = [rk.model_drivers(["a", "b"], means, p).alias(n) for n, p in (("p", plain), ("q", table))]
    got = rows.select(plain(F.array("a", "b")).alias("u"), table(F.array("a", "b")).alias("v"), *drivers).collect()
    assert [r.u for r in got] == [r.v for r in got] == [16.0, 16.0, 12.0, 20.0, 16.0, 12.0]
    assert [r.p for r in got] == [r.q for r in got]
    plan = rows.select(plain(F.array("a", "b")).alias("u"))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "lambdafunction" not in plan


def test_scored_rows_never_carry_trees(spark):
    """A model's 200 trees take hundreds of KB; beside every row of a join they filled an executor."""
    nodes = [(0, 1.5, 1, 2, 0.0), (-1, 0.0, -1, -1, 3.0), (-1, 0.0, -1, -1, 4.0)]
    model = spark.createDataFrame([("m", 1.0, 1, [nodes] * 3), ("n", 2.0, 1, [nodes])], f"market string, base double, depth int, trees array<{tr._NODE}>")
    rows = spark.createDataFrame([(i, "mn"[i % 2], float(i % 4)) for i in range(1200)] + [(-1, "m", float("nan")), (-2, None, 1.0)], "i int, market string, a double")
    out = tr.score_trees(rows, model, ["market"], ["a"])
    assert "trees" not in out._jdf.queryExecution().executedPlan().toString()
    want = {i: (1.0, 2.0)[i % 2] + (3, 1)[i % 2] * (3.0 if i % 4 <= 1 else 4.0) for i in range(1200)} | {-1: 13.0}
    assert {r.i: r.tree_raw for r in out.collect()} == want
