from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofspark import schemas
from asofspark.operators import checks as ck
from asofspark.operators import distribution as ds
from asofspark.operators import evaluate as ev
from asofspark.operators.ledger import Ledger, LedgerConflict, attempt_state, illegal_transitions
from asofspark.plans import feature_store as fs
from asofspark.plans.settle import settle
from asofspark.sources import publish as pb
from asofspark.sources import readers as rd

ROW = schemas.struct("id string, value double, retrieved_at_utc string")


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def test_append_is_idempotent_and_refuses_changes(spark, tmp_path):
    book = Ledger(str(tmp_path / "l"), ROW, ("id",))
    assert book.append(batch(spark, ("a", 1.0, "t1"), ("b", 2.0, "t1")), "r1") == {"inserted": 2, "unchanged": 0}
    assert book.append(batch(spark, ("a", 1.0, "t2"), ("c", 3.0, "t2")), "r2") == {"inserted": 1, "unchanged": 1}
    assert book.append(batch(spark, ("a", 1.0, "t2"), ("c", 3.0, "t2")), "r2") == {"inserted": 0, "unchanged": 1}
    with pytest.raises(LedgerConflict):
        book.append(batch(spark, ("a", 9.0, "t3"), ("d", 4.0, "t3")), "r3")
    assert sorted(r["id"] for r in book.read(spark).collect()) == ["a", "b", "c"]


def test_unpublished_runs_stay_invisible(spark, tmp_path):
    book = Ledger(str(tmp_path / "l"), ROW, ("id",))
    book.append(batch(spark, ("a", 1.0, "t")), "r1")
    batch(spark, ("x", 1.0, "t")).write.parquet(f"{book.path}/runs/run_id=lost/_bucket=0/_period=all")
    assert [r["id"] for r in book.read(spark).collect()] == ["a"]
    assert book.append(batch(spark, ("x", 2.0, "t")), "lost")["inserted"] == 1
    assert sorted((r["id"], r["value"]) for r in book.read(spark).collect()) == [("a", 1.0), ("x", 2.0)]


def test_repeats_inside_a_batch(spark, tmp_path):
    book = Ledger(str(tmp_path / "l"), ROW, ("id",))
    assert book.append(batch(spark, ("a", 1.0, "t1"), ("a", 1.0, "t2")), "r1")["inserted"] == 1
    with pytest.raises(LedgerConflict):
        book.append(batch(spark, ("z", 1.0, "t"), ("z", 2.0, "t")), "r2")


def test_failed_checks_publish_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    def check(d):
        return ck.duplicate_keys(d, "t", ["id"])

    pb.publish(batch(spark, ("a", 1.0, "t")), path, "v1", checks=check)
    with pytest.raises(pb.ChecksFailed, match="duplicate_keys"):
        pb.publish(batch(spark, ("a", 1.0, "t"), ("a", 2.0, "t")), path, "v2", checks=check)
    assert pb.current(spark, path).count() == 1
    with pytest.raises(pb.ChecksFailed):
        pb.publish_all({"one": batch(spark, ("a", 1.0, "t")), "two": batch(spark, ("b", 1.0, "t"), ("b", 1.0, "t"))}, str(tmp_path / "m"), "v1",
                       lambda s: ck.all_checks(*[ck.duplicate_keys(d, n, ["id"]) for n, d in s.items()]))
    assert not (tmp_path / "m" / "manifest").exists()


def test_a_refused_republish_leaves_the_good_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.publish(batch(spark, ("a", 1.0, "t")), path, "v1")
    with pytest.raises(pb.ChecksFailed):
        pb.publish(batch(spark, ("a", 1.0, "t"), ("a", 2.0, "t")), path, "v1", checks=lambda d: ck.duplicate_keys(d, "t", ["id"]))
    assert pb.current(spark, path).count() == 1


def test_tables_are_published_together(spark, tmp_path):
    def check(s):
        return ck.all_checks(*[ck.duplicate_keys(d, n, ["id"]) for n, d in s.items()])

    path = str(tmp_path / "m")
    pb.publish_all({"one": batch(spark, ("a", 1.0, "t")), "two": batch(spark, ("b", 1.0, "t"))}, path, "v1", check)
    with pytest.raises(pb.ChecksFailed):
        pb.publish_all({"one": batch(spark, ("c", 1.0, "t")), "two": batch(spark, ("b", 1.0, "t"), ("b", 1.0, "t"))}, path, "v2", check)
    assert [r["id"] for r in pb.current(spark, f"{path}/one").collect()] == ["a"]
    pb.publish_all({"one": batch(spark, ("c", 1.0, "t")), "two": batch(spark, ("d", 1.0, "t"))}, path, "v2", check)
    assert [r["id"] for n in ("one", "two") for r in pb.current(spark, f"{path}/{n}").collect()] == ["c", "d"]


def test_feature_store_refuses_a_leak(spark, tmp_path):
    t0 = datetime(2025, 9, 1)
    ok = spark.createDataFrame([("g1", "A", 2025, t0, None), ("g1", "B", 2025, t0, None)], "game_id string, team_id string, season int, kickoff_dt timestamp, lag1_kickoff_dt timestamp")
    ok = ok.withColumns({f"lag{k}_kickoff_dt": F.lit(None).cast("timestamp") for k in (2, 3, 4)})
    fs.write_lag_store(fs.require_no_leak(ok), str(tmp_path / "f"), "v1")
    leak = ok.withColumn("lag1_kickoff_dt", F.col("kickoff_dt") + F.expr("INTERVAL 1 DAY"))
    with pytest.raises(fs.LeakageError):
        fs.require_no_leak(leak)
    with pytest.raises(pb.ChecksFailed):
        fs.write_lag_store(leak, str(tmp_path / "f"), "v2")
    assert pb.current(spark, str(tmp_path / "f")).count() == 2


def test_readers_and_capture(spark, tmp_path):
    df = batch(spark, ("b", 2.0, "t"), ("a", 1.0, "t"))
    pb.write_csv(df, str(tmp_path / "csv"), ["id"])
    assert [r["id"] for r in rd.read_csv(spark, str(tmp_path / "csv"), ROW, "value > 1").collect()] == ["b"]
    pb.write_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    seasons = spark.range(6).select((F.col("id") % 3 + 2020).cast("int").alias("season"), "id")
    pb.write_parquet(seasons, str(tmp_path / "s"), ["season"])
    assert rd.read_seasons(spark, str(tmp_path / "s"), 2022).count() == 2
    assert rd.read_key(spark, str(tmp_path / "s"), "season", 2020).count() == 2
    prof = pb.capture({"rows": (df, None), "times": (spark.createDataFrame([(datetime(2026, 1, 1),)], "t timestamp"), "t")}, str(tmp_path / "c"), "c1")
    got = {r["dataset"]: r for r in prof.collect()}
    assert got["rows"]["rows"] == 2 and got["times"]["available_at"] == datetime(2026, 1, 1)
    merged = rd.ingest({2020: spark.range(2).select(F.col("id").cast("int").alias("a")), 2021: spark.range(1).select(F.lit("x").alias("b"))}, {"a": "bigint", "b": "string"})
    assert merged.schema.simpleString() == "struct<a:bigint,b:string,season:int>" and merged.count() == 3


def test_availability(spark):
    landed = spark.createDataFrame([("pbp", 2024, 5), ("inj", 2024, 0)], "dataset string, season int, rows long")
    errors = spark.createDataFrame([("pbp", 2025)], "dataset string, season int")
    got = {(r["dataset"], r["season"]): (r["status"], r["blocking"]) for r in rd.availability(landed, {"pbp": True, "inj": False}, [2024, 2025], errors).collect()}
    assert got == {("pbp", 2024): ("AVAILABLE", False), ("inj", 2024): ("EMPTY", False), ("pbp", 2025): ("ERROR", True), ("inj", 2025): ("NOT_AVAILABLE", False)}


def test_schema_checks(spark):
    df = batch(spark, ("a", 1.0, "t"))
    assert ck.assert_schema(df, ROW) is df
    with pytest.raises(ValueError, match="missing value double"):
        ck.assert_schema(df.withColumn("value", F.lit(1)), ROW)
    with pytest.raises(ValueError, match="another order"):
        ck.assert_schema(df.select("value", "id", "retrieved_at_utc"), ROW)
    with pytest.raises(ValueError, match="missing required columns: nope"):
        ck.require_columns(df, {"nope"})
    assert set(schemas.KEYS) == set(schemas.TABLES) and all(set(k) <= set(schemas.TABLES[t].names) for t, k in schemas.KEYS.items())


def test_hash_check_and_conditional_rules(spark):
    from asofspark.functions.scalars import content_hash

    df = batch(spark, ("a", 1.0, "t"), ("b", 2.0, "t"))
    stored = df.withColumn("content_hash", content_hash(df))
    assert ck.hash_mismatch(stored, "t").head()["violations"] == 0
    changed = stored.withColumn("value", F.when(F.col("id") == "a", 5.0).otherwise(F.col("value")))
    assert ck.hash_mismatch(changed, "t").head()["violations"] == 1
    rules = {"needs": ck.conditional_nulls(F.col("id") == "a", ["value"]), "order": ck.out_of_order("retrieved_at_utc", "id"), "domain": ck.not_in_domain("id", ("a",))}
    assert {r["check_id"]: r["violations"] for r in ck.check_bundle(df, "t", rules).collect()} == {"needs": 0, "order": 2, "domain": 1}


def test_attempts(spark):
    df = spark.createDataFrame([("k", 1, "PREPARED", "h"), ("k", 2, "SENT", "h"), ("k", 3, "PREPARED", "x")], "idempotency_key string, attempt int, status string, payload_hash string")
    r = attempt_state(df).head()
    assert (r["latest_status"], r["attempts"], r["conflict"]) == ("PREPARED", 3, True)
    bad = illegal_transitions(df, [(None, "PREPARED"), ("PREPARED", "SENT")]).collect()
    assert [(r["from_status"], r["to_status"]) for r in bad] == [("SENT", "PREPARED")]


KICKOFF = datetime(2026, 9, 20, 17)


@pytest.fixture
def settled_inputs(spark):
    games = spark.createDataFrame([("g", 2026, 2, KICKOFF, 24.0, 20.0), ("h", 2026, 2, KICKOFF, None, None)], "game_id string, season int, week int, kickoff_utc timestamp, home_score double, away_score double")
    snap = KICKOFF - timedelta(minutes=60)
    cols = (
        "prediction_id string, model_version string, snapshot_id string, provider_event_id string, game_id string, market string, kickoff_utc timestamp, snapshot_purpose string, "
        "eligibility_status string, snapshot_retrieved_at_utc timestamp, prediction_created_at_utc timestamp, anchor_updated_at_utc timestamp, anchor_line double, "
        "anchor_orientation_price int, anchor_other_price int, anchor_orientation_no_vig_probability double, final_projection double, calibrated_non_push_win_probability double, "
        "model_win_probability double, model_push_probability double, model_loss_probability double"
    )

    def row(pid, market, line, minutes=0, status="ELIGIBLE_CLOSE_PROXY", purpose="DECISION"):
        t = snap + timedelta(minutes=minutes)
        return (pid, "v", "snap", "e", "g", market, KICKOFF, purpose, status, t, t + timedelta(minutes=1), t - timedelta(minutes=5), line, -110, -110, 0.5, line + 0.5, 0.55, 0.5, 0.09, 0.41)

    preds = [row("p1", "spreads", 2.5), row("p2", "totals", 44.0), row("p3", "spreads", 9.5, minutes=-120), row("p4", "spreads", 9.5, minutes=10, status="INELIGIBLE_FEATURES")]
    close = KICKOFF - timedelta(minutes=15)
    quotes = [
        ("close", "e", "g", "spreads", s, "pinnacle", 3.5, p, f, 1.05, close, close - timedelta(minutes=5), "CLOSE", KICKOFF) for s, p, f in (("HOME", -105, 0.52), ("AWAY", -115, 0.48))
    ]
    qcols = (
        "snapshot_id string, provider_event_id string, game_id string, market string, selection string, bookmaker_key string, canonical_line double, american_price int, "
        "vig_free_probability double, overround double, retrieved_at_utc timestamp, source_updated_at_utc timestamp, snapshot_purpose string, kickoff_utc timestamp"
    )
    return games, spark.createDataFrame(preds, cols), spark.createDataFrame(quotes, qcols)


def run(settled_inputs, model=None):
    games, preds, quotes = settled_inputs
    out = settle(games, preds, quotes, "v", F.lit(KICKOFF - timedelta(days=5)), F.lit(KICKOFF + timedelta(days=1)), model)
    return {r["market"]: r for r in out.collect()}


def test_settlement_worked_case(settled_inputs, spark):
    rng = range(-40, 41)
    hist = spark.createDataFrame([(m, float(v) + (0 if m == "spreads" else 44), 0.0 if m == "spreads" else 44.0, float(i % 9)) for m in ("spreads", "totals") for i, v in enumerate(rng)], "market string, target double, final double, line double")
    got = run(settled_inputs, ds.fit_distribution(hist, ["market"]))
    s, t = got["spreads"], got["totals"]
    assert (s["prediction_id"], s["result"], s["decision_line"], s["closing_line"]) == ("p1", "WIN", 2.5, 3.5)
    assert s["line_clv"] == pytest.approx(1.0) and s["market_probability_movement"] == pytest.approx(0.02)
    assert list(s["key_numbers_crossed"]) == [3] and s["key_number_movement"] == "CROSSED_PRIMARY_KEY"
    assert s["model_brier"] == pytest.approx(0.45**2) and s["reconciliation_status"] == "RECONCILED"
    total = s["closing_contract_win_probability"] + s["closing_contract_push_probability"] + s["closing_contract_loss_probability"]
    fair = s["closing_contract_win_probability"] / (s["closing_contract_win_probability"] + s["closing_contract_loss_probability"])
    assert total == pytest.approx(1.0) and s["decision_price_clv"] == pytest.approx(fair - 110 / 210)
    assert (t["result"], t["clv_status"], t["eligible_non_push"]) == ("PUSH", "UNAVAILABLE_MISSING_CLOSE", 0)
    assert t["model_brier"] is None and t["line_clv"] is None and t["closing_contract_ev"] is None and t["key_numbers_crossed"] is None


def test_missing_decision_is_excluded_but_kept(settled_inputs):
    games, preds, quotes = settled_inputs
    got = run((games, preds.filter("market = 'totals'"), quotes))
    assert got["spreads"]["result"] == "EXCLUDED" and got["spreads"]["exclusion_reason"] == "NO_VALID_DECISION_PREDICTION"
    assert got["spreads"]["clv_status"] == "UNAVAILABLE_MISSING_DECISION" and got["spreads"]["eligible_non_push"] == 0


@pytest.mark.parametrize(
    "change,status",
    [
        (lambda q: q.withColumn("snapshot_id", F.lit("snap")), "SNAPSHOT_NOT_INDEPENDENT"),
        (lambda q: q.withColumn("provider_event_id", F.lit("other")), "PROVIDER_EVENT_MISMATCH"),
        (lambda q: q.withColumns({c: F.col(c) - F.expr("INTERVAL 50 MINUTES") for c in ("retrieved_at_utc", "source_updated_at_utc")}), "CLOSE_NOT_AFTER_DECISION"),
        (lambda q: q.withColumn("snapshot_purpose", F.lit("DIAGNOSTIC")), "MISSING_CLOSE_SNAPSHOT"),
    ],
)
def test_reconciliation_ladder(settled_inputs, change, status):
    games, preds, quotes = settled_inputs
    r = run((games, preds, change(quotes)))["spreads"]
    assert r["reconciliation_status"] == status and r["line_clv"] is None and r["model_brier"] is not None


def test_readiness_reasons(spark):
    games = spark.createDataFrame([("g", 1.0, 2.0), ("h", None, None)], "game_id string, home_score double, away_score double")
    evals = spark.createDataFrame([("g", "spreads", 1), ("g", "totals", 1)], "game_id string, market string, eligible_non_push int")
    markets = ["spreads", "totals"]
    assert ev.readiness(games, evals, markets, 1).head()["verdict"] == "DEFERRED_INCOMPLETE_RESULTS"
    done = games.filter("game_id = 'g'")
    assert ev.readiness(done, evals.limit(1), markets, 1).head()["verdict"] == "DEFERRED_MISSING_EVALUATIONS"
    assert ev.readiness(done, evals, markets, 2).head()["verdict"] == "DEFERRED_INSUFFICIENT_SAMPLE"
    assert ev.readiness(done, evals, markets, 1).head()["verdict"] == "READY"


def test_an_append_opens_only_the_parts_that_may_hold_its_keys(spark, tmp_path):
    """Files of other periods are spoilt; an append that opened one would fail."""
    rows = spark.range(4000).select(F.col("id").cast("int").alias("id"), (F.col("id") % 4 + 2020).cast("int").alias("season"), F.lit(1.0).alias("v"))
    book = Ledger(str(tmp_path / "l"), rows.schema, ("id", "season"), (), period="season", buckets=4)
    for s in (2020, 2021, 2022):
        assert book.append(rows.filter(F.col("season") == s), f"run {s}") == {"inserted": 1000, "unchanged": 0}
    again = rows.filter("season = 2022 AND id < 400")
    assert {(r, p) for r, _, p in book.parts_that_may_hold(again)} == {("run 2022", "2022")}
    assert book.parts_that_may_hold(rows.filter("season = 2023")) == []
    one = rows.filter("id = 2")
    assert len(book.parts_that_may_hold(one)) == 1
    for f in (tmp_path / "l" / "runs").rglob("*.parquet"):
        if "_period=2022" not in str(f):
            f.write_bytes(b"spoilt")
    assert book.append(again, "again") == {"inserted": 0, "unchanged": again.count()}
    assert book.append(rows.filter("season = 2023"), "new") == {"inserted": 1000, "unchanged": 0}
    with pytest.raises(LedgerConflict):
        book.append(again.withColumn("v", F.lit(2.0)), "other")


def test_a_capture_never_changes(spark, tmp_path):
    path = str(tmp_path / "c")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    second = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    one = pb.capture({"rows": (first, None)}, path, "c1", F.lit("2026-01-01")).collect()
    pb.capture({"rows": (second, None)}, path, "c2", F.lit("2026-01-05"))
    assert pb.capture({"rows": (first.repartition(3), None)}, path, "c1").collect() == one
    assert pb.captures(spark, path).count() == 2
    for tables in ({"rows": (second, None)}, {"rows": (first, None), "more": (second, None)}):
        with pytest.raises(pb.CaptureConflict):
            pb.capture(tables, path, "c1")
    read = lambda t: sorted(map(tuple, pb.as_known_at(spark, path, "rows", ["id"], F.lit(t)).collect()))
    assert read("2026-01-04") == [(1, "a"), (2, "b")]
    assert read("2026-01-05") == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(FileNotFoundError):
        read("2025-12-31")


def test_weekly_quotes_never_broadcast_the_events(spark, tmp_path):
    """Every event joins its game by shuffle, however small its file; repeated and missing ids count as in the SQL join."""
    from asofspark.catalog import ledgers

    rows = [(1, datetime(2024, 1, 2), 7), (1, datetime(2024, 1, 3), 7), (2, datetime(2024, 1, 4), 8), (None, datetime(2024, 1, 4), 9)]
    events = spark.createDataFrame([(e, t, u, "view", 1.0, "") for e, t, u in rows], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    quotes = ledgers._week_quotes(spark, str(tmp_path))
    assert "Broadcast" not in quotes._jdf.queryExecution().executedPlan().toString()
    assert {r["snapshot_id"]: r["n"] for r in quotes.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 4 * 24, 2: 24}


def test_contracts_of_quotes_shuffle_events_only(spark):
    """The event table is dealt out once; no quote and no contract is shuffled."""
    from asofspark.catalog import ledgers, prices

    sf = "/root/testdata/sf0.001"
    plans = [prices.complete_contracts(spark, sf), ledgers._candidates(spark, sf)]
    told = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert [t.count("Exchange ") for t in told] == [1, 1]
