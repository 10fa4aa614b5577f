from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofspark.operators import checks as ck
from asofspark.operators import observe as obs
from asofspark.operators import schedule as sched
from asofspark.operators import temporal as tmp

PLAY = (
    "game_id string, season int, week int, season_type string, posteam string, defteam string, epa double, success double, qb_dropback double, "
    "rush_attempt double, qb_kneel double, sack double, qb_hit double, qtr double, score_differential double"
)


def play(epa, success, dropback, rush, sack=0.0, hit=0.0, qtr=1.0, diff=0.0, kneel=0.0, season_type="REG", off="A", deff="B"):
    return ("g", 2025, 1, season_type, off, deff, epa, success, dropback, rush, kneel, sack, hit, qtr, diff)


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(
        [
            play(0.2, 1.0, 1.0, 0.0, 0.0, 1.0),
            play(-0.4, 0.0, 1.0, 0.0, 1.0, 1.0, 2.0, 3.0),
            play(0.3, 1.0, 0.0, 1.0),
            play(-5.0, 0.0, 0.0, 1.0, qtr=4.0),
            play(-5.0, 0.0, 0.0, 1.0, kneel=1.0),
            play(9.0, 1.0, 1.0, 0.0, season_type="POST"),
            play(None, 1.0, 1.0, 0.0),
        ],
        PLAY,
    )


def test_pressure_and_neutral_rates(plays):
    rows = {r["team_id"]: r for r in obs.extended_observations(plays).collect()}
    a, b = rows["A"], rows["B"]
    assert a["off_sack_rate"] == pytest.approx(0.5) and a["off_qb_hit_rate"] == pytest.approx(1.0)
    assert a["off_neutral_rush_epa"] == pytest.approx(0.3) and a["off_neutral_rush_success_rate"] == pytest.approx(1.0)
    assert a["off_pass_epa"] == pytest.approx(-0.1) and a["off_rush_epa"] == pytest.approx((0.3 - 5.0) / 2)
    assert a["def_pass_epa"] is None and b["def_pass_epa"] == pytest.approx(-0.1) and b["def_sack_rate"] == pytest.approx(0.5)


def test_two_steps_equal_one(plays):
    sums = obs.fact_sums(plays, obs.BASE_METRICS, keep=obs.PLAYED, only=obs.REGULAR)
    assert sorted(obs.entity_means(sums, obs.BASE_METRICS).collect()) == sorted(obs.base_observations(plays).collect())


def test_win_probability_window_limits_rates_but_not_pressure(spark):
    extra = ", wp double, pass_oe double, cpoe double, air_epa double, yac_epa double, yards_gained double, down double, ydstogo double, no_huddle double, shotgun double, special_teams_play double, play_type string"
    tail = (0.0, 1.0, 0.2, 0.3, 20.0, 1.0, 10.0, 0.0, 1.0, 0.0, "pass")
    df = spark.createDataFrame(
        [play(0.5, 1.0, 1.0, 0.0) + (0.5,) + tail, play(-3.0, 0.0, 1.0, 0.0, 1.0, 1.0) + (0.99,) + tail, play(-3.0, 0.0, 1.0, 0.0) + (0.05,) + tail], PLAY + extra
    )
    a = {r["team_id"]: r for r in obs.advanced_observations(df).collect()}["A"]
    assert a["off_wp_pass_epa"] == pytest.approx(0.5) and a["off_pass_explosive_rate"] == 1.0
    assert a["off_sack_rate"] == pytest.approx(1 / 3) and a["st_epa"] is None


def history(spark, values, season=2025):
    t0 = datetime(season, 9, 1)
    rows = [(f"g{i}", "A", season, t0 + timedelta(days=7 * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "game_id string, team_id string, season int, kickoff_dt timestamp, m double")


def decayed(df):
    lags = tmp.build_lags(df, ["m"])
    mean = tmp.decayed_mean([F.col(f"lag{k}_m") for k in range(1, 5)], tmp.decay_weights(2.0))
    return [(r["games_available"], r["x"]) for r in lags.select("*", mean.alias("x")).orderBy("kickoff_dt").collect()]


def test_lags_are_shifted_before_weighting(spark):
    got = decayed(history(spark, [1, 2, 3, 4, 5]))
    w = 2 ** -0.5
    assert got[0] == (0, None) and got[1] == (1, pytest.approx(1.0))
    assert got[2] == (2, pytest.approx((2 + w) / (1 + w))) and got[4][0] == 4


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 50], [1, 2, 3, 40, 50]])
def test_later_rows_never_reach_earlier_features(spark, values):
    base, changed = decayed(history(spark, [1, 2, 3, 4, 5])), decayed(history(spark, values))
    first = next(i for i, (a, b) in enumerate(zip([1, 2, 3, 4, 5], values)) if a != b)
    assert base[: first + 1] == changed[: first + 1]


def test_missing_lag_keeps_the_weights_of_the_others(spark):
    got = decayed(history(spark, [1, None, 3, 4]))
    assert got[2][1] == pytest.approx(1.0) and got[2][0] == 1


def test_split_lags_equal_plain_lags(spark):
    rows = spark.range(300).select(
        F.col("id").alias("game_id"), F.when(F.col("id") % 5 == 0, "B").otherwise("A").alias("team_id"), F.lit(1).alias("season"),
        (F.col("id") / 3).cast("int").alias("kickoff_dt"), (F.col("id") * 1.5).alias("m"),
    )
    plain = sorted(tmp.build_lags(rows, ["m"]).collect())
    split = sorted(tmp.build_lags(rows, ["m"], split=True).select(*tmp.build_lags(rows, ["m"]).columns).collect())
    assert plain == split


def test_priors_feed_the_next_season(spark):
    df = history(spark, [1, 2, 3, 4, 5], 2024).unionByName(history(spark, [10, 20], 2025))
    lags = tmp.build_lags(df, ["m"])
    out = tmp.materialize(lags, ["m"], [1.0], [0.5]).filter("season = 2025").orderBy("kickoff_dt").collect()
    prior = (5 + 4 / 2 + 3 / 4 + 2 / 8) / (1 + 1 / 2 + 1 / 4 + 1 / 8)
    assert out[0]["m"] == pytest.approx(prior)  # team and league prior agree with one team
    assert out[1]["m"] == pytest.approx(0.25 * 10 + 0.75 * prior)
    first = tmp.materialize(lags, ["m"], [1.0], [0.5]).filter("season = 2024").orderBy("kickoff_dt").head()
    assert first["m"] is None


def test_lag_boundary_check_sees_a_tie(spark):
    df = history(spark, [1, 2]).withColumn("kickoff_dt", F.lit(datetime(2025, 9, 1)))
    bad = ck.lag_boundaries(tmp.build_lags(df, ["m"])).filter("violations > 0").collect()
    assert [(r["check_id"], r["violations"]) for r in bad] == [("lag1_not_before", 1)]


def test_schedule_keeps_only_mutual_next_games(spark):
    rows = [("g1", "2026-09-01 17:00:00", "A", "B", 1.0, 2.0), ("g2", "2026-09-02 17:00:00", "C", "D", None, None), ("g3", "2026-09-09 17:00:00", "B", "C", None, None)]
    games = spark.createDataFrame(rows, "game_id string, kickoff_dt string, away_team string, home_team string, away_score double, home_score double").withColumn("kickoff_dt", F.col("kickoff_dt").cast("timestamp"))
    out = sched.known_schedule(games, F.lit("2026-09-02 12:00:00").cast("timestamp"), [])
    assert sorted(r["game_id"] for r in out.collect()) == ["g1", "g1", "g2", "g2"]
    started = games.withColumn("kickoff_dt", F.when(F.col("game_id") == "g2", F.lit("2026-09-02 11:00:00").cast("timestamp")).otherwise(F.col("kickoff_dt")))
    left = {r["game_id"] for r in sched.known_schedule(started, F.lit("2026-09-02 12:00:00").cast("timestamp"), []).collect()}
    assert left == {"g1", "g3"}  # started without a result: neither history nor next


def test_continuity_uses_the_previous_game(spark):
    usage = spark.createDataFrame(
        [(2025, "g1", "A", "back", 0.5, 0.6), (2025, "g1", "A", "left", 0.5, 0.4), (2025, "g2", "A", "back", 0.5, 0.6), (2025, "g2", "A", "new", 0.5, 0.4)],
        "season int, game_id string, team_id string, player_id string, offense_pct double, defense_pct double",
    )
    schedule = spark.createDataFrame([(2025, "g1", "A", 1), (2025, "g2", "A", 2), (2025, "g0", "A", 0)], "season int, game_id string, team_id string, kickoff_dt int")
    out = {r["game_id"]: r for r in obs.share_continuity(usage, schedule, {"offense_pct": "o", "defense_pct": "d"}).collect()}
    assert out["g1"]["o"] is None and out["g1"]["d"] is None
    assert out["g2"]["o"] == pytest.approx(0.5) and out["g2"]["d"] == pytest.approx(0.6)


def test_category_counts_are_zero_not_null(spark):
    df = spark.createDataFrame([(2025, 1, "A", "QB", "Out"), (2025, 1, "A", "CB", "Questionable"), (2025, 1, "B", "K", None)], "season int, week int, team_id string, position string, injury_status string")
    rows = {r["team_id"]: r for r in obs.category_counts(df).collect()}
    assert rows["A"]["qb_out_doubtful"] == 1 and rows["A"]["questionable_players"] == 1 and rows["B"]["qb_out_doubtful"] == 0


def test_opponent_gap(spark):
    cols = "game_id string, team_id string, opponent_team_id string, off_p double, def_p double, off_r double, def_r double"
    raw = spark.createDataFrame([("g", "A", "B", 0.30, 0.05, 0.20, 0.00), ("g", "B", "A", 0.10, 0.10, 0.00, 0.05)], cols)
    out = tmp.opponent_gap(raw, raw.drop("opponent_team_id"), {"pass": ("off_p", "def_p"), "rush": ("off_r", "def_r")}, ["game_id"])
    a = out.filter("team_id = 'A'").head()
    assert a["off_opp_adj_pass"] == pytest.approx(0.20) and a["def_opp_adj_pass"] == pytest.approx(-0.05) and a["off_opp_adj_rush"] == pytest.approx(0.15)
