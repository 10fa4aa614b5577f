"""Registered queries: scalar functions, prices, boards and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.catalog.bindings import (
    GAMES_SQL, PLAYS_SQL, QUOTES_SQL, dealt_events, games, implied_sql, play_sums, quotes, r6, rounded, table,
)
from asofspark.fixed_values import RETAIL_BOOKS
from asofspark.functions import prices as px
from asofspark.functions import scalars as sc
from asofspark.operators import market as mk
from asofspark.operators import observe as obs
from asofspark.operators.asof import mapped_lookup

_RETAIL = ", ".join(f"'{b}'" for b in RETAIL_BOOKS)
_ALIAS = {"SRC1": "ALPHA", "SRC3": "GAMMA"}
_SEGMENTS = {"AUTOMOBILE": "AUT", "BUILDING": "BLD", "FURNITURE": "FUR", "HOUSEHOLD": "HOU", "MACHINERY": "MAC"}
ZONE = "America/New_York"


def priced_quotes(spark, sf_dir, events=None, carry=()):
    """Quotes with margin-free probability and overround."""
    total = px.overround("american_price", "other_price")
    return quotes(spark, sf_dir, events, carry).select(
        "*",
        px.implied_probability("american_price").alias("implied_probability"),
        total.alias("overround"),
        F.when(total > 1.0, px.implied_probability("american_price") / total).alias("vig_free_probability"),
    )


_TOTAL = f"({implied_sql('american_price')} + {implied_sql('other_price')})"
PRICED_SQL = f"""{QUOTES_SQL},
priced AS (SELECT *, {implied_sql('american_price')} AS implied_probability, {_TOTAL} AS overround,
  CASE WHEN {_TOTAL} > 1 THEN {implied_sql('american_price')} / {_TOTAL} END AS vig_free_probability FROM quotes)"""


def identifiers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.select(
        "doc_id",
        sc.canonical_id(F.concat(F.lit("  "), "source", F.lit(" ")), _ALIAS).alias("canonical"),
        sc.fallback_id(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")), "source").alias("resolved"),
        sc.stable_id("doc_id", "lang", "source").alias("stable_id"),
    )


def display_names(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return mapped_lookup(cust, "c_mktsegment", _SEGMENTS, "segment_id")


def local_times(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    local_day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.date_format("ts", "HH:mm"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("Z")))
    return ev.select(
        "event_id",
        sc.civil_to_utc(local_day, clock, ZONE).cast("timestamp_ntz").alias("kickoff_utc"),
        sc.parse_utc(text).cast("timestamp_ntz").alias("parsed_utc"),
        F.date_format(sc.local_week_start("ts", "America/Toronto"), "yyyy-MM-dd").alias("week_bucket"),
        sc.season_of("ts").alias("season"),
    )


def content_hashes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", sc.content_hash(orders, ("o_orderpriority",)).alias("content_hash"))


_HASH_SQL = """sha256(concat_ws('|',
  'o_custkey=' || coalesce(length(o_custkey::VARCHAR) || ':' || o_custkey::VARCHAR, 'null'),
  'o_orderdate=' || coalesce(length(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')) || ':' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), 'null'),
  'o_orderkey=' || coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey::VARCHAR, 'null'),
  'o_orderstatus=' || coalesce(length(o_orderstatus) || ':' || o_orderstatus, 'null'),
  'o_totalprice=' || coalesce(length(pt) || ':' || pt, 'null')))"""
_HASH_FROM = """(SELECT *, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR
  ELSE o_totalprice::VARCHAR::DECIMAL(38,12)::VARCHAR END AS pt FROM orders) o"""


def dataset_digest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    hashed = orders.select("o_orderstatus", sc.content_hash(orders, ("o_orderpriority",)).alias("content_hash"))
    return hashed.groupBy("o_orderstatus").agg(sc.dataset_digest().alias("digest"))


_WORDS = ", ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS VARCHAR)" for i in range(8))


def american_prices(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return rounded(
        q.select(
            "provider_event_id", "bookmaker_key", "market", "selection",
            px.decimal_price("american_price").alias("decimal_price"),
            px.implied_probability("american_price").alias("implied_probability"),
            px.net_profit("american_price").alias("net_decimal_profit"),
            px.break_even("american_price").alias("break_even_probability"),
            px.overround("american_price", "other_price").alias("overround"),
            px.fair_probability("american_price", "other_price", True).alias("vig_free_probability"),
            px.canonical_line("market", "selection", "point").alias("canonical_line"),
            px.expected_roi(F.lit(0.5), F.lit(0.48), px.net_profit("american_price")).alias("expected_roi"),
        )
    )


_NET = "(CASE WHEN american_price > 0 THEN american_price / 100e0 ELSE 100e0 / abs(american_price) END)"


def training_fair_probability(spark, sf_dir):
    """Fair probabilities of the game matrix; zero prices give null."""
    g = games(play_sums(spark, sf_dir, obs.BASE_METRICS))
    return rounded(
        g.select(
            "game_id",
            px.fair_probability("home_spread_odds", "away_spread_odds").alias("market_spread_probability"),
            px.fair_probability("over_odds", "under_odds").alias("market_total_probability"),
            sc.equals_flag("roof", "outdoors").alias("is_outdoors"),
            sc.contains_flag("surface", "grass").alias("is_grass"),
            sc.all_present("home_score", "away_score", "roof").alias("complete"),
            F.least("home_score", "away_score").alias("lower_score"),
        )
    )


def probability_forms(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = F.col("l_discount") * 10 + F.lit(0.0)
    win, loss = px.contract_probabilities(F.col("l_discount") * 4 + 0.3, F.col("l_tax"))
    return rounded(
        li.groupBy("l_discount", "l_tax").agg(F.count(F.lit(1)).alias("rows")).select(
            "l_discount", "l_tax", "rows",
            sc.logit(p).alias("logit"),
            sc.logistic(F.col("l_discount") - F.col("l_tax")).alias("logistic"),
            sc.conservative_probability(p, "l_tax").alias("conservative"),
            win.alias("model_win"), loss.alias("model_loss"),
        )
    )


def key_number_movement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lines = li.select(
        F.when(F.col("l_linestatus") == "F", F.lit("spreads")).otherwise(F.lit("totals")).alias("market"),
        ((F.col("l_quantity") - 25) / 2).alias("decision_line"),
        ((F.col("l_quantity") - 25) / 2 + (F.col("l_linenumber") - 4) / 2).alias("closing_line"),
    )
    return (
        lines.select(
            "*",
            px.key_movement("market", "decision_line", "closing_line").alias("key_number_movement"),
            F.array_join(px.crossed_keys("decision_line", "closing_line"), ",").alias("keys"),
        )
        .groupBy("market", "decision_line", "closing_line", "key_number_movement", "keys")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def evidence_labels(spark, sf_dir):
    """Direction and source labels for both selections of every quote contract."""
    q = quotes(spark, sf_dir)
    weight = F.when(F.col("provider_event_id") % 5 == 0, 0.0).otherwise(0.25)
    adj = (F.col("provider_event_id") % 7 - 3) * weight
    p = F.lit(0.4) + (F.col("provider_event_id") % 20) / 100
    both = F.explode(
        F.array(
            F.struct(F.when(F.col("market") == "spreads", F.lit("HOME")).otherwise(F.lit("OVER")).alias("side"), p.alias("p")),
            F.struct(F.when(F.col("market") == "spreads", F.lit("AWAY")).otherwise(F.lit("UNDER")).alias("side"), (1 - p).alias("p")),
        )
    )
    one = q.filter("selection IN ('HOME', 'OVER')")
    return rounded(
        one.withColumn("_x", both).select(
            "provider_event_id", "bookmaker_key", "market", F.col("_x.side").alias("side"), F.col("_x.p").alias("model_probability"),
            px.signal_source(weight).alias("signal_source"), px.direction(F.col("_x.side"), adj).alias("direction"),
        )
    )


def board_quotes(spark, sf_dir):
    """Nested boards assembled from events, flattened back to quotes."""
    ev = table(spark, sf_dir, "events")

    def book(key: str, shift: int):
        price = F.expr(f"CAST(-104 - (event_id + {shift}) % 9 AS INT)")
        line = F.expr(f"(event_id % 15 - 7) / 2e0")
        outcome = lambda name, point, cost: F.struct(name.alias("name"), point.alias("point"), cost.alias("price"))
        return F.struct(
            F.lit(key).alias("key"), F.lit(key).alias("title"), F.col("ts").alias("last_update"),
            F.array(
                F.struct(
                    F.lit("spreads").alias("key"), F.col("ts").alias("last_update"),
                    F.array(outcome(F.lit("H"), -line, price), outcome(F.lit("A"), line, F.lit(-108))).alias("outcomes"),
                ),
                F.struct(
                    F.lit("totals").alias("key"), F.lit(None).cast("timestamp_ntz").alias("last_update"),
                    F.array(outcome(F.lit("Over"), line + 44, F.lit(-110)), outcome(F.lit("Under"), line + 44, price)).alias("outcomes"),
                ),
            ).alias("markets"),
        )

    boards = ev.select(
        F.col("event_id").alias("id"), F.col("ts").alias("commence_time"), F.lit("H").alias("home_team"),
        F.lit("A").alias("away_team"), F.col("event_type").alias("snapshot_id"), F.col("ts").alias("retrieved_at_utc"),
        F.array(book("pinnacle", 0), book("fanduel", 3), book("elsewhere", 5)).alias("bookmakers"),
    )
    return rounded(
        mk.flatten_board(boards).select(
            "provider_event_id", "snapshot_id", "bookmaker_key", "bookmaker_group", "market", "selection", "point",
            "canonical_line", "american_price", "vig_free_probability", "overround", "source_updated_at_utc",
        )
    )


_BOARD_SQL = f"""WITH b AS (SELECT e.event_id, e.ts, e.event_type, k.key, k.grp,
    CAST(-104 - (event_id + k.shift) % 9 AS INT) AS price, (event_id % 15 - 7) / 2e0 AS line
  FROM events e CROSS JOIN (VALUES ('pinnacle', 'anchor', 0), ('fanduel', 'retail', 3)) k(key, grp, shift)),
o AS (SELECT event_id, ts, event_type, key, grp, 'spreads' AS market, 'HOME' AS selection, -line AS point, line AS canonical_line, price AS p1, -108 AS p2 FROM b
  UNION ALL SELECT event_id, ts, event_type, key, grp, 'spreads', 'AWAY', line, line, -108, price FROM b
  UNION ALL SELECT event_id, ts, event_type, key, grp, 'totals', 'OVER', line + 44, line + 44, -110, price FROM b
  UNION ALL SELECT event_id, ts, event_type, key, grp, 'totals', 'UNDER', line + 44, line + 44, price, -110 FROM b)
SELECT event_id AS provider_event_id, event_type AS snapshot_id, key AS bookmaker_key, grp AS bookmaker_group, market, selection,
  {r6('point')} AS point, {r6('canonical_line')} AS canonical_line, p1 AS american_price,
  {r6(f"CASE WHEN {implied_sql('p1')} + {implied_sql('p2')} > 1 THEN {implied_sql('p1')} / ({implied_sql('p1')} + {implied_sql('p2')}) END")} AS vig_free_probability,
  {r6(f"{implied_sql('p1')} + {implied_sql('p2')}")} AS overround, ts AS source_updated_at_utc FROM o"""


def quote_freshness(spark, sf_dir):
    q = quotes(spark, sf_dir)
    start = F.date_trunc("HOUR", "retrieved_at_utc") + F.expr("INTERVAL 1 HOUR")
    return q.groupBy("bookmaker_key", "market").agg(
        F.count_if(mk.fresh("source_updated_at_utc", "retrieved_at_utc")).alias("fresh"),
        F.count_if(mk.in_close_window(start.cast("timestamp_ntz"), "retrieved_at_utc")).alias("in_window"),
        F.count_if(start.cast("timestamp_ntz") > F.col("retrieved_at_utc")).alias("unstarted"),
        F.count(F.lit(1)).alias("quotes"),
    )


def consensus(spark, sf_dir):
    c = mk.consensus(priced_quotes(spark, sf_dir, dealt_events(spark, sf_dir)))
    return rounded(c.withColumn("dislocated_books", F.array_join("dislocated_books", ",")))


_AGE = "date_diff('microsecond', source_updated_at_utc, retrieved_at_utc) / 60000000e0"
_FRESH = f"coalesce({_AGE} BETWEEN 0 AND 30, false)"
_ORIENTED = "(selection = 'HOME' OR selection = 'OVER')"
CONSENSUS_SQL = f"""{PRICED_SQL},
flagged AS (SELECT *, {_ORIENTED} AND {_FRESH} AND bookmaker_key = 'pinnacle' AS anc,
  {_ORIENTED} AND {_FRESH} AND bookmaker_key IN ({_RETAIL}) AS ret FROM priced),
cg AS (SELECT snapshot_id, provider_event_id, market,
  max(CASE WHEN anc THEN canonical_line END) AS anchor_line, avg(CASE WHEN ret THEN canonical_line END) AS retail_line_mean,
  max(CASE WHEN anc THEN vig_free_probability END) AS anchor_vig_free_probability,
  avg(CASE WHEN ret THEN vig_free_probability END) AS retail_vig_free_probability,
  count(CASE WHEN anc THEN 1 END) AS na, count(CASE WHEN ret THEN 1 END) AS retail_books_count,
  max(CASE WHEN anc OR ret THEN canonical_line END) - min(CASE WHEN anc OR ret THEN canonical_line END) AS spread,
  max(source_updated_at_utc) AS source_updated_at_utc
  FROM flagged GROUP BY 1, 2, 3),
dis AS (SELECT f.snapshot_id, f.provider_event_id, f.market, string_agg(bookmaker_key, ',' ORDER BY bookmaker_key) AS books
  FROM flagged f JOIN cg USING (snapshot_id, provider_event_id, market)
  WHERE ret AND abs(canonical_line - anchor_line) >= 0.5 GROUP BY 1, 2, 3),
consensus AS (SELECT cg.*, coalesce(dis.books, '') AS dislocated_books,
  CASE WHEN na > 0 AND retail_books_count > 0 THEN 0.6e0 * anchor_line + 0.4e0 * retail_line_mean ELSE anchor_line END AS consensus_line,
  CASE WHEN na > 0 AND retail_books_count > 0 AND spread < 1e-9 THEN 0.6e0 * anchor_vig_free_probability + 0.4e0 * retail_vig_free_probability END AS consensus_probability,
  coalesce(spread < 1e-9, false) AS same_point,
  CASE WHEN na = 0 AND retail_books_count > 0 THEN 'RETAIL_ONLY' WHEN na = 0 THEN 'UNAVAILABLE' WHEN retail_books_count = 0 THEN 'NO_RETAIL'
    WHEN retail_books_count < 2 THEN 'DEGRADED_RETAIL' WHEN NOT coalesce(spread < 1e-9, false) THEN 'INCOMPARABLE_POINTS' ELSE 'VALID' END AS status
  FROM cg LEFT JOIN dis USING (snapshot_id, provider_event_id, market))"""


def anchor_contracts(spark, sf_dir):
    c = mk.anchor_contract(priced_quotes(spark, sf_dir, dealt_events(spark, sf_dir)))
    prices = ("anchor_orientation_price", "anchor_other_price")
    return rounded(c.withColumns({p: F.col(p).cast("double") for p in prices}))


_ANCHOR = "bookmaker_key = 'pinnacle'"
_OPP = "(selection = 'AWAY' OR selection = 'UNDER')"
ANCHOR_CTE = f"""ag AS (SELECT {{keys}},
  count(CASE WHEN {_ANCHOR} THEN 1 END) AS n, count(CASE WHEN {_ANCHOR} AND {_ORIENTED} THEN 1 END) AS n1,
  count(CASE WHEN {_ANCHOR} AND {_OPP} THEN 1 END) AS n2,
  max(CASE WHEN {_ANCHOR} AND {_ORIENTED} THEN canonical_line END) AS l1, max(CASE WHEN {_ANCHOR} AND {_OPP} THEN canonical_line END) AS l2,
  max(CASE WHEN {_ANCHOR} AND {_ORIENTED} THEN american_price END) AS p1, max(CASE WHEN {_ANCHOR} AND {_OPP} THEN american_price END) AS p2,
  max(CASE WHEN {_ANCHOR} AND {_ORIENTED} THEN vig_free_probability END) AS f1, max(CASE WHEN {_ANCHOR} AND {_ORIENTED} THEN overround END) AS o1,
  min(CASE WHEN {_ANCHOR} THEN overround END) AS omin, count(CASE WHEN {_ANCHOR} AND source_updated_at_utc IS NULL THEN 1 END) AS nou,
  min(CASE WHEN {_ANCHOR} THEN source_updated_at_utc END) AS oldest, max(CASE WHEN {_ANCHOR} THEN source_updated_at_utc END) AS newest,
  max(retrieved_at_utc) AS snapshot_retrieved_at_utc FROM {{source}} GROUP BY ALL),
ar AS (SELECT *, CASE WHEN n <> 2 THEN 'PINNACLE_TWO_SIDED_CONTRACT_MISSING' WHEN n1 <> 1 OR n2 <> 1 THEN 'PINNACLE_SELECTIONS_INVALID'
  WHEN coalesce(abs(l1 - l2) > 1e-9, true) THEN 'PINNACLE_POINTS_DIFFER' WHEN coalesce(omin <= 1, true) THEN 'PINNACLE_OVERROUND_INVALID'
  WHEN nou > 0 THEN 'PINNACLE_UPDATE_TIME_MISSING' WHEN newest > snapshot_retrieved_at_utc THEN 'PINNACLE_UPDATE_AFTER_SNAPSHOT'
  WHEN date_diff('microsecond', oldest, snapshot_retrieved_at_utc) / 60000000e0 > {{age}} THEN 'PINNACLE_QUOTE_STALE' END AS reason FROM ag),
anchor AS (SELECT *, reason IS NULL AS contract_valid, (reason IS NULL OR reason IN ('PINNACLE_UPDATE_TIME_MISSING', 'PINNACLE_UPDATE_AFTER_SNAPSHOT', 'PINNACLE_QUOTE_STALE')) AS priced FROM ar)"""


def complete_contracts(spark, sf_dir):
    c = mk.complete_contracts(priced_quotes(spark, sf_dir, dealt_events(spark, sf_dir)))
    return rounded(
        c.select(
            "snapshot_id", "provider_event_id", "bookmaker_key", "market", "canonical_line", "overround", "fair_sum",
            F.col("orientation.american_price").alias("orientation_price"), F.col("other.american_price").alias("other_price"),
        )
    )


QUERIES = {
    "identifiers": identifiers,
    "display_names": display_names,
    "local_times": local_times,
    "content_hashes": content_hashes,
    "dataset_digest": dataset_digest,
    "american_prices": american_prices,
    "training_fair_probability": training_fair_probability,
    "probability_forms": probability_forms,
    "key_number_movement": key_number_movement,
    "evidence_labels": evidence_labels,
    "board_quotes": board_quotes,
    "quote_freshness": quote_freshness,
    "consensus": consensus,
    "anchor_contracts": anchor_contracts,
    "complete_contracts": complete_contracts,
}

_KEYS_SQL = "(VALUES (-14), (-10), (-7), (-6), (-3), (3), (6), (7), (10), (14)) k(k)"
ORACLES = {
    "identifiers": """SELECT doc_id, CASE upper(trim(source)) WHEN 'SRC1' THEN 'ALPHA' WHEN 'SRC3' THEN 'GAMMA' ELSE upper(trim(source)) END AS canonical,
      CASE WHEN doc_id % 3 = 0 OR lang IS NULL OR lang = '' THEN 'UNRESOLVED:' || coalesce(source, '') ELSE lang END AS resolved,
      sha256(concat_ws('|', doc_id::VARCHAR, lang, source)) AS stable_id FROM documents""",
    "display_names": "SELECT c_custkey, c_mktsegment, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENTS.items())
    + " END AS segment_id FROM customer",
    # the winter month of the table lies wholly at UTC-5 in both zones
    "local_times": """SELECT event_id,
      CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END + INTERVAL 5 HOUR AS kickoff_utc,
      CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS parsed_utc,
      strftime(CAST(ts - INTERVAL 5 HOUR AS DATE) - CAST((isodow(ts - INTERVAL 5 HOUR) + 5) % 7 AS INT), '%Y-%m-%d') AS week_bucket,
      CAST(year(ts) AS INT) AS season FROM events""",
    "content_hashes": f"SELECT o_orderkey, {_HASH_SQL} AS content_hash FROM {_HASH_FROM}",
    "dataset_digest": f"""SELECT o_orderstatus, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_WORDS})) AS digest
      FROM (SELECT o_orderstatus, {_HASH_SQL} AS h FROM {_HASH_FROM}) x GROUP BY o_orderstatus""",
    "american_prices": f"""WITH {QUOTES_SQL} SELECT provider_event_id, bookmaker_key, market, selection,
      {r6('1 + ' + _NET)} AS decimal_price, {r6(implied_sql('american_price'))} AS implied_probability, {r6(_NET)} AS net_decimal_profit,
      {r6(f'1 / (1 + {_NET})')} AS break_even_probability, {r6(_TOTAL)} AS overround,
      {r6(f"CASE WHEN {_TOTAL} > 1 THEN {implied_sql('american_price')} / {_TOTAL} END")} AS vig_free_probability,
      {r6('canonical_line')} AS canonical_line, {r6(f'0.5e0 * {_NET} - 0.48e0')} AS expected_roi FROM quotes""",
    "training_fair_probability": f"""WITH {PLAYS_SQL}, {GAMES_SQL} SELECT game_id,
      {r6(f"{implied_sql('home_spread_odds')} / ({implied_sql('home_spread_odds')} + {implied_sql('away_spread_odds')})")} AS market_spread_probability,
      {r6(f"{implied_sql('over_odds')} / ({implied_sql('over_odds')} + {implied_sql('under_odds')})")} AS market_total_probability,
      CAST(lower(roof) = 'outdoors' AS DOUBLE) AS is_outdoors, CAST(lower(surface) LIKE '%grass%' AS DOUBLE) AS is_grass,
      home_score IS NOT NULL AND away_score IS NOT NULL AND roof IS NOT NULL AS complete, {r6('least(home_score, away_score)')} AS lower_score FROM games""",
    "probability_forms": f"""SELECT l_discount, l_tax, rows, {r6('ln(p / (1 - p))')} AS logit, {r6('1 / (1 + exp(-(l_discount - l_tax)))')} AS logistic,
      {r6('greatest(0, least(1, l_discount * 10 - l_tax))')} AS conservative, {r6('(1 - l_tax) * (l_discount * 4 + 0.3e0)')} AS model_win,
      {r6('(1 - l_tax) * (1 - (l_discount * 4 + 0.3e0))')} AS model_loss
      FROM (SELECT l_discount, l_tax, count(*) AS rows, greatest(1e-8, least(1 - 1e-8, l_discount * 10)) AS p FROM lineitem GROUP BY 1, 2) x""",
    "key_number_movement": f"""WITH l AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'spreads' ELSE 'totals' END AS market,
        (l_quantity - 25) / 2e0 AS decision_line, (l_quantity - 25) / 2e0 + (l_linenumber - 4) / 2e0 AS closing_line FROM lineitem),
      d AS (SELECT market, decision_line, closing_line, count(*) AS rows FROM l GROUP BY ALL),
      x AS (SELECT d.*,
        (SELECT string_agg(k, ',' ORDER BY k) FROM {_KEYS_SQL} WHERE k > least(decision_line, closing_line) AND k < greatest(decision_line, closing_line)) AS crossed,
        (SELECT string_agg(k, ',' ORDER BY k) FROM {_KEYS_SQL} WHERE k = decision_line OR k = closing_line) AS touched,
        (SELECT count(*) FROM {_KEYS_SQL} WHERE abs(k) IN (3, 7) AND k > least(decision_line, closing_line) AND k < greatest(decision_line, closing_line)) AS pc,
        (SELECT count(*) FROM {_KEYS_SQL} WHERE abs(k) IN (3, 7) AND (k = decision_line OR k = closing_line)) AS pt FROM d)
      SELECT market, decision_line, closing_line, rows, coalesce(crossed, touched, '') AS keys,
        CASE WHEN market <> 'spreads' THEN 'NOT_APPLICABLE' WHEN pc > 0 THEN 'CROSSED_PRIMARY_KEY' WHEN crossed IS NOT NULL THEN 'CROSSED_KEY'
          WHEN pt > 0 THEN 'TOUCHED_PRIMARY_KEY' WHEN touched IS NOT NULL THEN 'TOUCHED_KEY' ELSE 'NO_KEY_CROSSING' END AS key_number_movement FROM x""",
    "evidence_labels": f"""WITH {QUOTES_SQL}, a AS (SELECT provider_event_id, bookmaker_key, market, CASE WHEN provider_event_id % 5 = 0 THEN 0e0 ELSE 0.25e0 END AS w,
        (provider_event_id % 7 - 3) AS a, 0.4e0 + (provider_event_id % 20) / 100e0 AS p FROM quotes
        WHERE selection IN ('HOME', 'OVER')),
      s AS (SELECT *, CASE market WHEN 'spreads' THEN 'HOME' ELSE 'OVER' END AS side, p AS q, true AS pos FROM a
        UNION ALL SELECT *, CASE market WHEN 'spreads' THEN 'AWAY' ELSE 'UNDER' END, 1 - p, false FROM a)
      SELECT provider_event_id, bookmaker_key, market, side, {r6('q')} AS model_probability,
        CASE WHEN w = 0 THEN 'MARKET_CALIBRATION_ONLY' ELSE 'FOOTBALL_ADJUSTED' END AS signal_source,
        CASE WHEN a * w = 0 THEN 'NEUTRAL' WHEN pos = (a * w > 0) THEN 'SUPPORTS_SELECTION' ELSE 'OPPOSES_SELECTION' END AS direction FROM s""",
    "board_quotes": _BOARD_SQL,
    "quote_freshness": f"""WITH {QUOTES_SQL} SELECT bookmaker_key, market, count(CASE WHEN {_FRESH} THEN 1 END) AS fresh,
      count(CASE WHEN date_diff('microsecond', retrieved_at_utc, date_trunc('hour', retrieved_at_utc) + INTERVAL 1 HOUR) / 60000000e0 BETWEEN 5 AND 90 THEN 1 END) AS in_window,
      count(CASE WHEN date_trunc('hour', retrieved_at_utc) + INTERVAL 1 HOUR > retrieved_at_utc THEN 1 END) AS unstarted, count(*) AS quotes
      FROM quotes GROUP BY 1, 2""",
    "consensus": f"""WITH {CONSENSUS_SQL} SELECT snapshot_id, provider_event_id, market, {r6('anchor_line')} AS anchor_line, {r6('retail_line_mean')} AS retail_line_mean,
      {r6('consensus_line')} AS consensus_line, {r6('anchor_vig_free_probability')} AS anchor_vig_free_probability,
      {r6('retail_vig_free_probability')} AS retail_vig_free_probability, {r6('consensus_probability')} AS consensus_probability, same_point,
      retail_books_count, status, dislocated_books, source_updated_at_utc FROM consensus""",
    "anchor_contracts": f"""WITH {PRICED_SQL}, {ANCHOR_CTE.format(keys='snapshot_id, provider_event_id, market', source='priced', age='30')}
      SELECT snapshot_id, provider_event_id, market, snapshot_retrieved_at_utc, contract_valid, reason,
      {r6('CASE WHEN priced THEN l1 END')} AS anchor_line, CAST(CASE WHEN priced THEN p1 END AS DOUBLE) AS anchor_orientation_price, CAST(CASE WHEN priced THEN p2 END AS DOUBLE) AS anchor_other_price,
      {r6('CASE WHEN priced THEN f1 END')} AS anchor_orientation_no_vig_probability, {r6('CASE WHEN priced THEN o1 END')} AS anchor_overround,
      CASE WHEN priced AND nou = 0 THEN newest END AS anchor_updated_at_utc FROM anchor""",
    "complete_contracts": f"""WITH {PRICED_SQL}, c AS (SELECT snapshot_id, provider_event_id, bookmaker_key, market, canonical_line, count(*) AS n,
        count(CASE WHEN {_ORIENTED} THEN 1 END) AS n1, count(CASE WHEN {_OPP} THEN 1 END) AS n2, min(overround) AS overround,
        sum(vig_free_probability) AS fair_sum, min(source_updated_at_utc) AS oldest, max(source_updated_at_utc) AS newest, count(source_updated_at_utc) AS times,
        max(retrieved_at_utc) AS seen, max(CASE WHEN {_ORIENTED} THEN american_price END) AS orientation_price, max(CASE WHEN {_OPP} THEN american_price END) AS other_price
        FROM priced GROUP BY 1, 2, 3, 4, 5)
      SELECT snapshot_id, provider_event_id, bookmaker_key, market, {r6('canonical_line')} AS canonical_line, {r6('overround')} AS overround, {r6('fair_sum')} AS fair_sum,
        orientation_price, other_price FROM c WHERE n = 2 AND n1 = 1 AND n2 = 1 AND times = 2 AND newest <= seen
        AND date_diff('microsecond', oldest, seen) / 60000000e0 <= 30 AND overround > 1 AND abs(fair_sum - 1) <= 1e-9""",
}
