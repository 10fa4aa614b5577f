"""The driver's tables in the roles the operators expect.

The derived columns are plain SQL expressions valid in Spark and in ANSI
engines alike, so the comparison queries start from the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.operators import observe as obs
from asofspark.session import checkpointed

# lineitem joined to orders, customer and supplier, as a play-level fact table
PLAY_COLUMNS = {
    "season": "CAST(year(o_orderdate) AS INT)",
    "week": "CAST(month(o_orderdate) AS INT)",
    "home_team": "least(c_nationkey, s_nationkey)",
    "away_team": "greatest(c_nationkey, s_nationkey)",
    "posteam": "c_nationkey",
    "defteam": "s_nationkey",
    "player_id": "l_suppkey",
    "season_type": "CASE WHEN l_linenumber = 7 AND l_tax > 0.07 THEN 'POST' ELSE 'REG' END",
    "epa": "(l_extendedprice * (1 - l_discount) - 35000) / 9973",
    "success": "CASE WHEN l_returnflag <> 'R' THEN 1e0 ELSE 0e0 END",
    "qb_dropback": "CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END",
    "rush_attempt": "CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END",
    "qb_kneel": "CASE WHEN l_linenumber = 1 AND l_tax = 0 THEN 1e0 WHEN l_tax > 0.075 THEN NULL ELSE 0e0 END",
    "sack": "CASE WHEN l_discount > 0.085 THEN 1e0 ELSE 0e0 END",
    "qb_hit": "CASE WHEN l_discount > 0.055 THEN 1e0 ELSE 0e0 END",
    "qtr": "CAST(floor((l_linenumber + 1) / 2e0) AS DOUBLE)",
    "score_differential": "l_quantity - 25",
    "wp": "l_discount * 10",
    "pass_oe": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax * 100 - 4 END",
    "cpoe": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 100 - 5 END",
    "air_epa": "l_extendedprice * l_tax / 997",
    "yac_epa": "l_extendedprice * l_discount / 997",
    "yards_gained": "l_quantity - 20",
    "down": "1 + (l_linenumber - 1) % 4",
    "ydstogo": "l_quantity % 10",
    "no_huddle": "CASE WHEN l_tax > 0.055 THEN 1e0 ELSE 0e0 END",
    "shotgun": "CASE WHEN l_discount < 0.045 THEN 1e0 ELSE 0e0 END",
    "special_teams_play": "CASE WHEN l_linenumber IN (5, 6) THEN 1e0 ELSE 0e0 END",
    "play_type": (
        "CASE WHEN l_returnflag = 'A' THEN 'punt' WHEN l_returnflag = 'R' THEN 'kickoff'"
        " WHEN l_quantity > 25 THEN 'field_goal' ELSE 'extra_point' END"
    ),
    "quantity": "l_quantity",
}
GAME_ID = "(season * 100 + week) * 10000 + home_team * 100 + away_team"

# one row per pair of nations and month, with scores, lines and prices
GAME_COLUMNS = {
    "kickoff_dt": (
        "make_timestamp(season, week, CAST(1 + (home_team * 25 + away_team) % 28 AS INT), "
        "CAST(floor((home_team * 25 + away_team) / 60e0) AS INT), CAST((home_team * 25 + away_team) % 60 AS INT), 0)"
    ),
    "game_type": "CASE WHEN (home_team + away_team + week) % 9 = 0 THEN 'POST' ELSE 'REG' END",
    "home_score": "home_sum % 45",
    "away_score": "away_sum % 42",
    "home_rest": "CAST(4 + (home_team + week) % 9 AS DOUBLE)",
    "away_rest": "CAST(4 + (away_team * 3 + week) % 9 AS DOUBLE)",
    "spread_line": "(total_sum % 29 - 14) / 2e0",
    "total_line": "40 + (total_sum % 17) / 2e0",
    "home_spread_odds": "CASE WHEN total_sum % 97 = 0 THEN 0 ELSE CAST(-115 + total_sum % 13 AS INT) END",
    "away_spread_odds": "CASE WHEN total_sum % 5 = 0 THEN 105 ELSE CAST(-112 + total_sum % 7 AS INT) END",
    "over_odds": "CAST(-113 + total_sum % 11 AS INT)",
    "under_odds": "CASE WHEN total_sum % 7 = 0 THEN 102 ELSE CAST(-110 + total_sum % 5 AS INT) END",
    "roof": "CASE WHEN (home_team + away_team) % 3 = 0 THEN 'Outdoors' WHEN week = 1 THEN NULL ELSE 'dome' END",
    "surface": "CASE WHEN home_team % 2 = 0 THEN 'Grass_A' ELSE 'a_turf' END",
}

# one row per event, book, market and selection; books are positions 1..6
BOOKS = {1: "pinnacle", 2: "draftkings", 3: "fanduel", 4: "betmgm", 5: "williamhill_us", 6: "otherbook"}
QUOTE_LINE = {
    "spreads": "(event_id % 21 - 10) / 2e0 + CASE WHEN (event_id + book) % 4 = 0 THEN 0.5e0 ELSE 0e0 END",
    "totals": "40 + (event_id % 15) / 2e0 + CASE WHEN (event_id + 2 * book) % 5 = 0 THEN 0.5e0 ELSE 0e0 END",
}
QUOTE_PRICE = {
    "first": "CAST(CASE WHEN (event_id + book) % 17 = 0 THEN 100 ELSE -100 - (event_id * 7 + book * 13) % 21 END AS INT)",
    "second": "CAST(CASE WHEN (event_id + book) % 17 = 0 THEN 100 ELSE -118 + (event_id * 7 + book * 13) % 17 END AS INT)",
}
QUOTE_AGE_MINUTES = "CAST((event_id * 3 + book * 7) % 47 - 4 AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items()]


def sql_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-level facts. Joins carry no hints: sizes decide, AQE splits hot keys."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(*exprs(PLAY_COLUMNS)).withColumn("game_id", F.expr(GAME_ID))


PLAYS_SQL = f"""plays AS (
  SELECT *, {GAME_ID} AS game_id FROM (
    SELECT {sql_list(PLAY_COLUMNS)}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) p0)"""


def play_sums(spark: SparkSession, sf_dir: str, metrics: list[obs.Metric]) -> DataFrame:
    """One pass over the plays for both the games and the observations, written once."""
    extra = [F.sum("quantity").alias("quantity"), F.first("home_team").alias("home_team"), F.first("away_team").alias("away_team")]
    return checkpointed(
        obs.fact_sums(plays(spark, sf_dir), metrics, keep=obs.PLAYED, only=obs.REGULAR, extra=extra)
    )


def games(sums: DataFrame) -> DataFrame:
    """Games dimension from the compact play sums of two different teams."""
    totals = (
        sums.filter("home_team <> away_team")
        .groupBy("game_id", "season", "week", "home_team", "away_team")
        .agg(
            F.sum(F.when(F.col("posteam") == F.col("home_team"), F.col("quantity"))).alias("home_sum"),
            F.sum(F.when(F.col("posteam") == F.col("away_team"), F.col("quantity"))).alias("away_sum"),
            F.sum("quantity").cast("bigint").alias("total_sum"),
        )
    )
    return totals.select("game_id", "season", "week", "home_team", "away_team", *exprs(GAME_COLUMNS)).withColumn(
        "kickoff_dt", F.col("kickoff_dt").cast("timestamp_ntz")
    )


GAMES_SQL = f"""games AS (
  SELECT game_id, season, week, home_team, away_team, {sql_list(GAME_COLUMNS)} FROM (
    SELECT game_id, season, week, home_team, away_team,
      sum(CASE WHEN posteam = home_team THEN quantity END) AS home_sum,
      sum(CASE WHEN posteam = away_team THEN quantity END) AS away_sum,
      CAST(sum(quantity) AS BIGINT) AS total_sum
    FROM plays WHERE home_team <> away_team GROUP BY ALL) g0)"""


EVENTS_A_TASK = 50_000
"""An event becomes 24 quotes; those of so many are grouped in a task's memory."""


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt out by id before they become quotes, so boards and contracts are grouped without shuffling a quote.

    The tasks grow with the table; its rows are counted from the file's footers.
    """
    ev = table(spark, sf_dir, "events")
    parts = max(spark.sparkContext.defaultParallelism, -(-ev.count() // EVENTS_A_TASK))
    return ev.repartition(parts, "event_id")


def quotes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two-sided quotes of six books on two markets per event; ``carry`` names further columns of ``events``."""
    ev = table(spark, sf_dir, "events") if events is None else events
    books = F.explode(F.array(*[F.struct(F.lit(i).alias("book"), F.lit(k).alias("bookmaker_key")) for i, k in BOOKS.items()]))
    markets = F.explode(F.array(F.lit("spreads"), F.lit("totals")))
    rows = ev.select("event_id", "ts", "user_id", "event_type", "value", *carry, books.alias("_b")).select("*", "_b.*", markets.alias("market"))
    rows = rows.withColumn(
        "canonical_line",
        F.when(F.col("market") == "spreads", F.expr(QUOTE_LINE["spreads"])).otherwise(F.expr(QUOTE_LINE["totals"])),
    )
    first = F.struct(
        F.when(F.col("market") == "spreads", F.lit("HOME")).otherwise(F.lit("OVER")).alias("selection"),
        F.when(F.col("market") == "spreads", -F.col("canonical_line")).otherwise(F.col("canonical_line")).alias("point"),
        F.expr(QUOTE_PRICE["first"]).alias("american_price"),
        F.expr(QUOTE_PRICE["second"]).alias("other_price"),
    )
    second = F.struct(
        F.when(F.col("market") == "spreads", F.lit("AWAY")).otherwise(F.lit("UNDER")).alias("selection"),
        F.col("canonical_line").alias("point"),
        F.expr(QUOTE_PRICE["second"]).alias("american_price"),
        F.expr(QUOTE_PRICE["first"]).alias("other_price"),
    )
    age = F.make_interval(mins=F.expr(QUOTE_AGE_MINUTES))
    return rows.select("*", F.explode(F.array(first, second)).alias("_o")).select(
        F.date_format("ts", "yyyyMMdd").alias("snapshot_id"),
        F.col("event_id").alias("provider_event_id"),
        "user_id",
        "event_type",
        "bookmaker_key",
        "market",
        "_o.selection",
        "_o.point",
        "canonical_line",
        "_o.american_price",
        "_o.other_price",
        F.col("ts").alias("retrieved_at_utc"),
        F.when(F.expr("(event_id + book) % 23 <> 0"), F.col("ts") - age).alias("source_updated_at_utc"),
        *carry,
    )


QUOTES_SQL = f"""q0 AS (
  SELECT e.*, b.book, b.bookmaker_key, m.market,
    CASE WHEN m.market = 'spreads' THEN {QUOTE_LINE['spreads']} ELSE {QUOTE_LINE['totals']} END AS canonical_line
  FROM events e
  CROSS JOIN (VALUES {', '.join(f"({i}, '{k}')" for i, k in BOOKS.items())}) b(book, bookmaker_key)
  CROSS JOIN (VALUES ('spreads'), ('totals')) m(market)),
quotes AS (
  SELECT strftime(ts, '%Y%m%d') AS snapshot_id, event_id AS provider_event_id, user_id, event_type, bookmaker_key, market,
    s.selection, CASE WHEN s.selection = 'HOME' THEN -canonical_line ELSE canonical_line END AS point, canonical_line,
    CASE WHEN s.side = 1 THEN {QUOTE_PRICE['first']} ELSE {QUOTE_PRICE['second']} END AS american_price,
    CASE WHEN s.side = 1 THEN {QUOTE_PRICE['second']} ELSE {QUOTE_PRICE['first']} END AS other_price,
    ts AS retrieved_at_utc,
    CASE WHEN (event_id + book) % 23 <> 0 THEN ts - to_minutes({QUOTE_AGE_MINUTES}) END AS source_updated_at_utc
  FROM q0 JOIN (VALUES ('spreads', 1, 'HOME'), ('spreads', 2, 'AWAY'), ('totals', 1, 'OVER'), ('totals', 2, 'UNDER'))
    s(mk, side, selection) ON s.mk = q0.market)"""

IMPLIED = "(CASE WHEN {p} < 0 THEN -{p} / (100e0 - {p}) WHEN {p} > 0 THEN 100e0 / (100e0 + {p}) END)"


def implied_sql(p: str) -> str:
    return IMPLIED.format(p=p)


# large-N binary outcomes with two probabilities
SCORED_COLUMNS = {
    "l_orderkey": "l_orderkey",
    "market": "CASE WHEN l_linestatus = 'F' THEN 'spreads' ELSE 'totals' END",
    "season": "CAST(year(l_shipdate) AS INT)",
    "week": "CAST(month(l_shipdate) AS INT)",
    "outcome": "CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END",
    "model_probability": "0.2e0 + 3 * l_discount + l_tax",
    "market_probability": "0.25e0 + 2 * l_discount + l_quantity / 500",
    "actual": "l_quantity",
    "line": "25 + l_tax * 100",
    "projection": "25 + l_discount * 50",
}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*exprs(SCORED_COLUMNS))


SCORED_SQL = f"scored AS (SELECT {sql_list(SCORED_COLUMNS)} FROM lineitem)"


# Means of 0/1 values often end in a 5 at the seventh decimal, where the last
# bit of a sum would decide the rounding; both engines round a little beside it.
NUDGE = "3.1e-8"


def r6(expr: str) -> str:
    """Six decimals, with negative zero folded into zero."""
    return f"(round(({expr}) + {NUDGE}, 6) + 0e0)"


def rounded(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Doubles to six decimals, for comparison across engines."""
    return df.select(
        *[
            F.round(F.col(c) + float(NUDGE), 6).alias(c) if t == "double" and c not in (keep or []) else F.col(c)
            for c, t in df.dtypes
        ]
    )
