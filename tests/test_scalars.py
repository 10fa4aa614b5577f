from datetime import date

import pytest
from pyspark.sql import functions as F

from asofspark.fixed_values import TEAM_ALIASES, TEAM_NAMES
from asofspark.functions import prices as px
from asofspark.functions import scalars as sc
from asofspark.operators.asof import mapped_lookup


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_aliases_and_names(spark):
    df = spark.createDataFrame([(" jac ",), ("KC",), (None,)], "t string")
    assert [r[0] for r in df.select(sc.canonical_id("t", TEAM_ALIASES)).collect()] == ["JAX", "KC", None]
    assert len(TEAM_NAMES) == 32
    ok = mapped_lookup(spark.createDataFrame([("Green Bay Packers",)], "n string"), "n", TEAM_NAMES, "id").head()
    assert ok["id"] == "GB"
    with pytest.raises(Exception, match="unmapped n"):
        mapped_lookup(spark.createDataFrame([("Nobody",)], "n string"), "n", TEAM_NAMES, "id").collect()


def test_fallback_id(spark):
    df = spark.createDataFrame([("", "X"), (None, None), ("7", "Y")], "i string, n string")
    assert [r[0] for r in df.select(sc.fallback_id("i", "n")).collect()] == ["UNRESOLVED:X", "UNRESOLVED:", "7"]


def test_civil_time_crosses_both_clock_changes(spark):
    df = spark.createDataFrame(
        [("2026-03-07", "13:00"), ("2026-03-08", "13:00"), ("2026-10-31", "13:00"), ("2026-11-01", "13:00"), ("2026-09-10", "")], "d string, t string"
    )
    got = [str(r[0]) for r in df.select(F.date_format(sc.civil_to_utc("d", "t", "America/New_York"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-03-07 18:00", "2026-03-08 17:00", "2026-10-31 17:00", "2026-11-01 18:00", "2026-09-10 04:00"]


def test_naive_times_are_rejected(spark):
    df = spark.createDataFrame([("2026-09-13T12:00:00Z",), ("2026-09-13T08:00:00-04:00",), ("2026-09-13T12:00:00",), ("junk",)], "t string")
    got = [r[0] for r in df.select(F.date_format(sc.parse_utc("t"), "HH:mm")).collect()]
    assert got == ["12:00", "12:00", None, None]


def test_week_opens_on_local_tuesday(spark):
    df = spark.createDataFrame([("2026-09-21T02:00:00Z",), ("2026-09-22T03:59:00Z",), ("2026-09-22T04:00:00Z",)], "t string")
    got = [r[0] for r in df.select(sc.local_week_start(sc.parse_utc("t"), "America/Toronto")).collect()]
    assert got == [date(2026, 9, 15), date(2026, 9, 15), date(2026, 9, 22)]


def test_prices(spark):
    r = one(
        spark, px.decimal_price(F.lit(-110)), px.decimal_price(F.lit(0)), px.fair_probability(F.lit(-110), F.lit(-110), True),
        px.fair_probability(F.lit(100), F.lit(100), True), px.net_profit(F.lit(150)), px.break_even(F.lit(-110)), px.implied_probability(F.lit(-110)),
    )
    assert r[0] == pytest.approx(1.909090909) and r[1] is None and r[2] == pytest.approx(0.5) and r[3] is None
    assert r[4] == pytest.approx(1.5) and r[5] == pytest.approx(110 / 210) and r[6] == pytest.approx(110 / 210)


@pytest.mark.parametrize(
    "market,a,b,label,keys",
    [
        ("spreads", 2.5, 3.5, "CROSSED_PRIMARY_KEY", [3]),
        ("spreads", 5.5, 6.5, "CROSSED_KEY", [6]),
        ("spreads", 3.0, 2.5, "TOUCHED_PRIMARY_KEY", [3]),
        ("spreads", 10.0, 10.0, "TOUCHED_KEY", [10]),
        ("spreads", 4.0, 5.0, "NO_KEY_CROSSING", []),
        ("spreads", -3.5, 3.5, "CROSSED_PRIMARY_KEY", [-3, 3]),
        ("totals", 44.0, 47.0, "NOT_APPLICABLE", []),
    ],
)
def test_key_numbers(spark, market, a, b, label, keys):
    r = one(spark, px.key_movement(F.lit(market), F.lit(a), F.lit(b)), px.crossed_keys(F.lit(a), F.lit(b)))
    assert r[0] == label and list(r[1]) == keys


@pytest.mark.parametrize(
    "selection,adj,weight,source,direction",
    [
        ("HOME", 2.0, 0.5, "FOOTBALL_ADJUSTED", "SUPPORTS_SELECTION"),
        ("AWAY", 2.0, 0.5, "FOOTBALL_ADJUSTED", "OPPOSES_SELECTION"),
        ("UNDER", -1.0, 0.5, "FOOTBALL_ADJUSTED", "SUPPORTS_SELECTION"),
        ("OVER", -1.0, 0.5, "FOOTBALL_ADJUSTED", "OPPOSES_SELECTION"),
        ("HOME", 2.0, 0.0, "MARKET_CALIBRATION_ONLY", "NEUTRAL"),
    ],
)
def test_direction_truth_table(spark, selection, adj, weight, source, direction):
    r = one(spark, px.signal_source(F.lit(weight)), px.direction(F.lit(selection), F.lit(adj * weight)))
    assert (r[0], r[1]) == (source, direction)


def test_content_hash_ignores_transient_columns_and_number_form(spark):
    a = spark.createDataFrame([(1, 2.0, "x", "t1")], "a int, b double, c string, retrieved_at_utc string")
    b = spark.createDataFrame([("x", 1, 2.0, "t2")], "c string, a int, b double, retrieved_at_utc string")
    c = spark.createDataFrame([(1, 2.5, "x", "t1")], "a int, b double, c string, retrieved_at_utc string")
    ha, hb, hc = (d.select(sc.content_hash(d)).head()[0] for d in (a, b, c))
    assert ha == hb != hc
    nan = spark.createDataFrame([(float("nan"),)], "b double")
    null = spark.createDataFrame([(None,)], "b double")
    assert nan.select(sc.content_hash(nan)).head() == null.select(sc.content_hash(null)).head()


def test_dataset_digest_ignores_row_order(spark):
    df = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    shuffled = df.orderBy(F.rand(3))
    assert df.agg(sc.dataset_digest()).head() == shuffled.agg(sc.dataset_digest()).head()
    assert df.agg(sc.dataset_digest()).head() != df.union(df.limit(1)).agg(sc.dataset_digest()).head()


def test_logit_clips_and_keeps_nulls(spark):
    r = one(spark, sc.logit(F.lit(1.0)), sc.logit(F.lit(None).cast("double")), sc.logistic(sc.logit(F.lit(0.3))), sc.conservative_probability(F.lit(0.01), F.lit(0.02)))
    assert r[0] == pytest.approx(18.42068, abs=1e-4) and r[1] is None and r[2] == pytest.approx(0.3) and r[3] == 0.0
