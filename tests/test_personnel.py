from datetime import datetime

import pytest
from pyspark.sql import functions as F

from asofspark.operators import personnel

GAMES = [(f"w{i}", datetime(2026, 9, 7 * i, 17)) for i in range(1, 5)]
CUTOFF = datetime(2026, 10, 5, 12)


@pytest.fixture
def frames(spark):
    mk = spark.createDataFrame
    return {
        "requests": mk([("r", "AAA", 2026, 5, CUTOFF)], "request_id string, team_id string, season int, week int, cutoff timestamp"),
        "depth": mk(
            [("AAA", datetime(2026, 10, 5, 11), "QB", 1, "s"), ("AAA", datetime(2026, 10, 5, 11), "QB", 2, "b"),
             ("AAA", datetime(2026, 10, 5, 18), "QB", 1, "b"), ("AAA", datetime(2026, 10, 5, 18), "QB", 2, "s")],
            "team_id string, dt timestamp, position string, pos_rank int, player_id string",
        ),
        "statuses": mk([("AAA", 2026, 5, "s", "QB", "Out"), ("AAA", 2026, 6, "b", "QB", "Out")], "team_id string, season int, week int, player_id string, position string, status string"),
        "players": mk([("s", "S0"), ("b", "B0")], "player_id string, share_player_id string"),
        "team_games": mk([("AAA", g, t) for g, t in GAMES], "team_id string, game_id string, kickoff_utc timestamp"),
        "shares": mk([("AAA", "S0", g, v) for (g, _), v in zip(GAMES, (1.0, 0.9, 0.8, 0.7))] + [("AAA", "S0", "w6", 0.0)], "team_id string, share_player_id string, game_id string, share double"),
        "facts": mk([("s", g, t, 0.4) for g, t in GAMES] + [("b", *GAMES[3], -0.2), ("b", "w6", datetime(2026, 10, 12, 17), 100.0)], "player_id string, game_id string, kickoff_utc timestamp, epa double"),
    }


def shock(frames, **changes):
    return personnel.replacement_shock(**{**frames, **changes}, half_life=4.0, prior_strength=0.0).head()


def test_latest_depth_before_the_decision_and_earlier_games_only(frames):
    r = shock(frames)
    assert r["eligibility_status"] == "ELIGIBLE_RESEARCH_ONLY" and (r["starter_player_id"], r["backup_player_id"]) == ("s", "b")
    assert r["lost_share"] == pytest.approx(0.85) and r["starter_rate"] == pytest.approx(0.4) and r["backup_rate"] == pytest.approx(-0.2)
    assert r["shock"] == pytest.approx(-0.51)


@pytest.mark.parametrize(
    "table,change,status,value",
    [
        ("statuses", lambda d: d.withColumn("status", F.lit("Questionable")), "NO_QUALIFYING_EVENT", 0.0),
        ("statuses", lambda d: d.filter("week = 6"), "INELIGIBLE_MISSING_INJURY_COVERAGE", None),
        ("statuses", lambda d: d.union(d), "INELIGIBLE_AMBIGUOUS_INJURY", None),
        ("depth", lambda d: d.filter("pos_rank = 1"), "INELIGIBLE_AMBIGUOUS_DEPTH", None),
        ("depth", lambda d: d.filter("dt > '2026-10-05 12:00:00'"), "INELIGIBLE_MISSING_DEPTH", None),
        ("depth", lambda d: d.withColumn("player_id", F.when(F.col("pos_rank") == 1, F.col("player_id"))), "INELIGIBLE_MISSING_DEPTH_ID", None),
        ("players", lambda d: d.filter("player_id = 'b'"), "INELIGIBLE_MISSING_STARTER_CROSSWALK", None),
        ("team_games", lambda d: d.filter("game_id <> 'w1'"), "INELIGIBLE_MISSING_STARTER_VOLUME", None),
        ("shares", lambda d: d.filter("game_id <> 'w2'"), "INELIGIBLE_MISSING_STARTER_VOLUME", None),
        ("facts", lambda d: d.filter("player_id = 'b'"), "INELIGIBLE_MISSING_STARTER_RATE", None),
        ("facts", lambda d: d.filter("player_id = 's'"), "INELIGIBLE_MISSING_BACKUP_RATE", None),
    ],
)
def test_incomplete_evidence_is_null_and_named(frames, table, change, status, value):
    r = shock(frames, **{table: change(frames[table])})
    assert (r["eligibility_status"], r["shock"]) == (status, value)


def test_difference_is_null_when_a_side_is(spark):
    df = spark.createDataFrame([(1.0, 0.25), (None, 0.5)], "h double, a double")
    assert [r[0] for r in df.select(personnel.game_difference("h", "a")).collect()] == [0.75, None]


def test_rate_weights_recent_games_and_shrinks_to_the_mean(spark, frames):
    req = spark.createDataFrame([("r", "s", CUTOFF)], "request_id string, player_id string, cutoff timestamp")
    facts = frames["facts"].withColumn("epa", F.when(F.col("game_id") == "w4", 1.0).otherwise(F.col("epa")))
    got = personnel.decayed_rates(req, facts, 1.0, 2.0).head()["rate"]
    w = [1, 0.5, 0.25, 0.125]
    mean = (0.4 * 3 + 1.0 + 1.0) / 5
    assert got == pytest.approx((1.0 + 0.4 * (0.5 + 0.25 + 0.125) + 2 * mean) / (sum(w) + 2))


def test_decayed_rates_over_a_long_history(spark):
    half_life, n = 0.02, 60  # blocks of ten games
    for half_life, n in ((0.02, 60), (1.0, 1_203)):
        facts = spark.range(n).select(
            F.lit("a").alias("player_id"),
            F.col("id").alias("game_id"),
            F.timestamp_seconds(F.col("id") * 86400).alias("kickoff_utc"),
            (F.col("id") % 7).cast("double").alias("epa"),
        )
        req = spark.range(0, n + 1, 13).select(F.col("id").alias("request_id"), F.lit("a").alias("player_id"), F.timestamp_seconds(F.col("id") * 86400).alias("cutoff"))
        got = {r.request_id: r.rate for r in personnel.decayed_rates(req, facts, half_life, 2.0).collect()}
        for i, rate in got.items():
            w = [2.0 ** (-k / half_life) for k in range(i)]
            x = [(i - 1 - k) % 7 for k in range(i)]
            want = (sum(a * b for a, b in zip(w, x, strict=True)) + 2.0 * (sum(x) / i)) / (sum(w) + 2.0) if i else None
            assert rate is None if want is None else abs(rate - want) < 1e-9, (half_life, i)
