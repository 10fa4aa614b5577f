import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofspark.operators import asof
from asofspark.operators import market as mk
from asofspark.operators import rank as rk
from asofspark.sources import readers as rd

QUOTE = (
    "snapshot_id string, provider_event_id string, market string, selection string, bookmaker_key string, canonical_line double, american_price int, "
    "vig_free_probability double, overround double, retrieved_at_utc timestamp, source_updated_at_utc timestamp"
)
NOW = datetime(2026, 9, 13, 12)


def q(book, line, p=0.5, age=5.0, selection="HOME", price=-110, over=1.05, market="spreads"):
    seen = None if age is None else NOW - timedelta(minutes=age)
    return ("s", "e", market, selection, book, line, price, p, over, NOW, seen)


def consensus(spark, rows, minutes=None):
    return mk.consensus(spark.createDataFrame(rows, QUOTE), freshness_minutes=minutes).head()


def test_equal_points_blend_line_and_probability(spark):
    c = consensus(spark, [q("pinnacle", 3.0, 0.52), q("draftkings", 3.0, 0.50), q("fanduel", 3.0, 0.48)])
    assert c["status"] == "VALID" and c["consensus_line"] == pytest.approx(3.0) and c["consensus_probability"] == pytest.approx(0.508)


def test_different_points_blend_only_the_line(spark):
    c = consensus(spark, [q("pinnacle", 3.0, 0.52), q("draftkings", 3.5), q("fanduel", 4.0)])
    assert c["status"] == "INCOMPARABLE_POINTS" and c["consensus_probability"] is None and c["consensus_line"] == pytest.approx(3.3)
    assert list(c["dislocated_books"]) == ["draftkings", "fanduel"]


def test_without_or_with_stale_anchor_only_retail_is_left(spark):
    c = consensus(spark, [q("draftkings", 2.5), q("fanduel", 2.5)])
    assert c["status"] == "RETAIL_ONLY" and c["consensus_line"] is None
    c = consensus(spark, [q("pinnacle", 3.0, 0.52, age=120), q("draftkings", 3.0, age=10), q("fanduel", 3.0, age=10)], 30)
    assert c["status"] == "RETAIL_ONLY" and c["anchor_line"] is None and c["retail_books_count"] == 2


@pytest.mark.parametrize("rows,status", [([("pinnacle", 3.0)], "NO_RETAIL"), ([("pinnacle", 3.0), ("betmgm", 3.0)], "DEGRADED_RETAIL"), ([("other", 3.0)], "UNAVAILABLE")])
def test_consensus_status_ladder(spark, rows, status):
    assert consensus(spark, [q(*r) for r in rows])["status"] == status


@pytest.mark.parametrize(
    "rows,reason",
    [
        ([q("pinnacle", 3.0)], "PINNACLE_TWO_SIDED_CONTRACT_MISSING"),
        ([q("pinnacle", 3.0), q("pinnacle", 3.0)], "PINNACLE_SELECTIONS_INVALID"),
        ([q("pinnacle", 3.0), q("pinnacle", 3.5, selection="AWAY")], "PINNACLE_POINTS_DIFFER"),
        ([q("pinnacle", 3.0, over=1.0), q("pinnacle", 3.0, selection="AWAY")], "PINNACLE_OVERROUND_INVALID"),
        ([q("pinnacle", 3.0, age=None), q("pinnacle", 3.0, selection="AWAY")], "PINNACLE_UPDATE_TIME_MISSING"),
        ([q("pinnacle", 3.0, age=-1), q("pinnacle", 3.0, selection="AWAY")], "PINNACLE_UPDATE_AFTER_SNAPSHOT"),
        ([q("pinnacle", 3.0, age=31), q("pinnacle", 3.0, age=1, selection="AWAY")], "PINNACLE_QUOTE_STALE"),
        ([q("pinnacle", 3.0, age=30), q("pinnacle", 3.0, age=1, selection="AWAY")], None),
    ],
)
def test_anchor_reasons_in_order(spark, rows, reason):
    c = mk.anchor_contract(spark.createDataFrame(rows, QUOTE)).head()
    assert c["reason"] == reason and c["contract_valid"] == (reason is None)
    if reason is None:
        assert c["anchor_updated_at_utc"] == NOW - timedelta(minutes=1)


def board(outcomes=None, price=-110):
    market = {"key": "spreads", "last_update": "2026-09-13T11:50:00Z", "outcomes": outcomes or [{"name": "H", "point": -3.5, "price": price}, {"name": "A", "point": 3.5, "price": -110}]}
    books = [{"key": k, "title": k, "last_update": "2026-09-13T11:00:00Z", "markets": [market, {"key": "h2h", "outcomes": []}]} for k in ("pinnacle", "unknown")]
    return [{"id": "e1", "commence_time": "2026-09-13T17:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": books}]


def test_board_files_are_read_and_flattened(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(board()))
    rows = mk.flatten_board(rd.read_boards(spark, str(tmp_path))).orderBy("selection").collect()
    assert [r["selection"] for r in rows] == ["AWAY", "HOME"] and {r["bookmaker_key"] for r in rows} == {"pinnacle"}
    assert [r["canonical_line"] for r in rows] == [3.5, 3.5] and rows[0]["vig_free_probability"] == pytest.approx(0.5)
    assert all(r["board_error"] is None for r in rows) and rows[0]["snapshot_id"] == "b.json"


@pytest.mark.parametrize(
    "payload,error",
    [
        (board([{"name": "H", "point": -3.5, "price": -110}]), "NOT_TWO_SIDED"),
        (board([{"name": "H", "point": -3.5, "price": 100}, {"name": "A", "point": 3.5, "price": 100}]), "OVERROUND_INVALID"),
        (board(price=0), "PRICE_INVALID"),
    ],
)
def test_broken_boards_are_named(spark, payload, error):
    df = spark.createDataFrame([("s", json.dumps(payload))], "snapshot_id string, payload string").withColumn("retrieved_at_utc", F.lit(NOW))
    rows = mk.flatten_board(rd.parse_boards(df)).collect()
    assert {r["board_error"] for r in rows} == {error}


def test_matching_is_inclusive_and_one_to_one(spark):
    ev = spark.createDataFrame([("e1", "H", NOW), ("e2", "H", NOW + timedelta(days=3)), ("e3", "H", NOW + timedelta(days=9)), ("e4", "H", NOW + timedelta(days=9, hours=1))], "eid string, k string, t timestamp")
    sc = spark.createDataFrame([("g1", "H", NOW + timedelta(hours=8)), ("g2", "H", NOW + timedelta(days=3, hours=8, seconds=1)), ("g3", "H", NOW + timedelta(days=9))], "gid string, k string, s timestamp")
    got = asof.interval_match(ev, sc, ["k"], "t", "s", "eid", "gid", 8 * 3600).collect()
    assert [(r["eid"], r["gid"]) for r in got] == [("e1", "g1")]  # g2 is too far, g3 has two candidates


def test_asof_boundary(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 5), (3, "k", 4), (4, "z", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 9, "b")], "k string, rt int, v string")
    loose = {r["id"]: r["v"] for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"], "id").collect()}
    strict = {r["id"]: r["v"] for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"], "id", inclusive=False).collect()}
    assert loose == {1: "b", 2: "a", 3: None, 4: None} and strict == {1: "b", 2: None, 3: None, 4: None}


def test_checked_join_refuses_duplicates(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    dup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        asof.checked_join(left, dup, ["k"]).collect()
    assert asof.checked_join(left, dup.filter("v <> 'b'"), ["k"]).count() == 2


def test_ranking_is_conservative_and_keeps_one_exposure(spark):
    rows = [("g1", "spreads", "HOME", "pinnacle", 0.58, 0.52, 0.05, 0.02, 1.0), ("g1", "spreads", "AWAY", "retail", 0.56, 0.50, 0.05, 0.02, 1.0), ("g2", "totals", "OVER", "pinnacle", 0.53, 0.52, 0.0, 0.02, 1.0)]
    df = spark.createDataFrame(rows, "game_id string, market string, selection string, book string, model_probability double, market_fair_probability double, push_probability double, probability_margin double, net_decimal_profit double")
    out = rk.rank_candidates(rk.conservative(df)).collect()
    assert [(r["game_id"], r["selection"]) for r in out] == [("g1", "HOME")]
    assert out[0]["conservative_probability"] == pytest.approx(0.56) and out[0]["conservative_edge"] == pytest.approx(0.04)
    assert out[0]["conservative_roi"] == pytest.approx(0.95 * 0.56 - 0.95 * 0.44)


def test_line_movement(spark):
    df = spark.createDataFrame([("c", NOW + timedelta(minutes=i), float(v)) for i, v in enumerate([3, 3.5, 3])], "k string, t timestamp, line double")
    assert [r["line_movement"] for r in mk.line_movement(df, ["k"], "t", "line").orderBy("t").collect()] == [None, 0.5, -0.5]
