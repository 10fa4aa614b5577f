"""Registered queries: schedules, joins, windows, sets and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofspark.catalog import features as ft
from asofspark.catalog.bindings import GAMES_SQL, PLAYS_SQL, games, play_sums, plays, r6, rounded, table
from asofspark.operators import asof, personnel, scan
from asofspark.operators import market as mk
from asofspark.operators import observe as obs
from asofspark.operators import schedule as sched
from asofspark.operators import temporal as tmp

_ASOF = "1998-06-15 00:00:00"


def known_schedule(spark, sf_dir):
    g = games(play_sums(spark, sf_dir, obs.BASE_METRICS)).filter("game_type = 'REG'")
    return sched.known_schedule(g, F.lit(_ASOF).cast("timestamp_ntz"), ["season", "week"])


def drifting_slices(spark, sf_dir):
    """Yearly slices with different columns, read as one."""
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("year(o_orderdate) < 1998").select("o_orderkey", "o_totalprice")
    new = orders.filter("year(o_orderdate) >= 1998").select("o_orderkey", "o_orderstatus", F.col("o_totalprice"))
    return sched.union_slices([old, new]).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def first_write(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return sched.keep_first(ev, ["user_id", "event_type"], ["ts", "event_id"])


def last_write(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return sched.last_write_wins(ev, ["user_id", "event_type"], "event_id")


def distinct_members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


def game_sequence(spark, sf_dir):
    """Sequence number, recency index and the last four of each entity season."""
    rows = ft.team_games(spark, sf_dir).select("team_id", "season", "kickoff_dt", "game_id")
    numbered = tmp.sequence_numbers(rows, ["team_id", "season"], ["kickoff_dt", "game_id"])
    back = tmp.recency_index(numbered, ["team_id", "season"], ["kickoff_dt", "game_id"])
    return back.withColumn("in_last_four", F.col("games_ago") < 4)


def member_continuity(spark, sf_dir):
    p = plays(spark, sf_dir)
    usage = p.groupBy("season", "game_id", F.col("posteam").alias("team_id"), "player_id").agg(
        F.sum("quantity").alias("offense_pct"), F.sum("yards_gained").alias("_y")
    ).withColumn("defense_pct", F.greatest(F.col("_y"), F.lit(0.0))).drop("_y")
    sched_rows = p.groupBy("season", "game_id", F.col("posteam").alias("team_id"), "week").agg(
        F.min("home_team").alias("h"), F.min("away_team").alias("a")
    ).select("season", "game_id", "team_id", F.expr("week * 100000 + h * 100 + a").alias("kickoff_dt"))
    return rounded(
        obs.share_continuity(usage, sched_rows, {"offense_pct": "off_snap_continuity", "defense_pct": "def_snap_continuity"})
    )


_CONT_SQL = f"""WITH {PLAYS_SQL},
usage AS (SELECT season, game_id, posteam AS team_id, player_id, sum(quantity) AS o, greatest(sum(yards_gained), 0) AS d,
  min(week * 100000 + home_team * 100 + away_team) AS k FROM plays GROUP BY 1, 2, 3, 4),
gm AS (SELECT season, team_id, game_id, row_number() OVER (PARTITION BY team_id, season ORDER BY min(k), game_id) AS n
  FROM usage GROUP BY season, team_id, game_id),
cur AS (SELECT u.*, gm.n FROM usage u JOIN gm USING (season, team_id, game_id)),
s AS (SELECT c.season, c.game_id, c.team_id, c.n, sum(c.o) AS od, sum(least(c.o, coalesce(p.o, 0))) AS onum,
  sum(c.d) AS dd, sum(least(c.d, coalesce(p.d, 0))) AS dnum
  FROM cur c LEFT JOIN cur p ON p.season = c.season AND p.team_id = c.team_id AND p.player_id = c.player_id AND p.n = c.n - 1
  GROUP BY 1, 2, 3, 4)
SELECT season, game_id, team_id, {r6('CASE WHEN n > 1 AND od > 0 THEN onum / od END')} AS off_snap_continuity,
  {r6('CASE WHEN n > 1 AND dd > 0 THEN dnum / dd END')} AS def_snap_continuity FROM s"""


def category_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.expr("CAST(year(o_orderdate) AS INT)").alias("season"), F.expr("CAST(month(o_orderdate) AS INT)").alias("week"),
        (F.col("o_custkey") % 25).alias("team_id"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'QB' WHEN '2-HIGH' THEN 'G' WHEN '3-MEDIUM' THEN 'LB' ELSE 'CB' END").alias("position"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Out' WHEN 'O' THEN 'Questionable' ELSE 'Doubtful' END").alias("injury_status"),
    )
    return obs.category_counts(rows)


def line_movement(spark, sf_dir):
    """Change of each contract's value against its previous snapshot."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("value").alias("line"))
    return rounded(mk.line_movement(e, ["event_type"], "ts", "line", "event_id"))


def split_lags(spark, sf_dir):
    """Lags of raw events per type, each type split over time."""
    e = table(spark, sf_dir, "events").select("event_type", F.year("ts").alias("season"), "ts", "event_id", "value")
    return tmp.build_lags(e, ["value"], "event_type", "season", "ts", "event_id", split=True)


def latest_view(spark, sf_dir):
    """Latest view at or before each purchase of the same user."""
    ev = table(spark, sf_dir, "events")
    left = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return asof.asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], "event_id", True, ["view_id"])


def matched_events(spark, sf_dir):
    """One-to-one matches of clicks and signups of a user within eight hours."""
    ev = table(spark, sf_dir, "events")
    left = ev.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    right = ev.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("signup_ts"))
    return asof.interval_match(left, right, ["user_id"], "click_ts", "signup_ts", "click_id", "signup_id", 8 * 3600)


def tercile_edges(spark, sf_dir):
    return rounded(scan.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [1 / 3, 2 / 3], ["l_returnflag"]))


def equal_bins(spark, sf_dir):
    """Five equal-count bins of the whole fact table, ties split by key order."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_discount") - F.col("l_tax")).alias("edge"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_partkey",
        "l_quantity", F.expr("CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END").alias("outcome"), "l_shipdate",
    )
    order = [F.col(c) for c in ("edge", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "outcome")]
    return rounded(
        scan.equal_count_bins(li, order, 5)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("edge").alias("mean_edge"), F.avg("outcome").alias("observed_rate"))
    )


def decayed_rates(spark, sf_dir):
    """Recency-weighted rate with an additive prior for every purchase of a user."""
    ev = table(spark, sf_dir, "events")
    req = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("player_id"), F.col("ts").alias("cutoff"))
    facts = ev.filter("event_type <> 'purchase'").select(
        F.col("user_id").alias("player_id"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("kickoff_utc"),
        F.date_format("ts", "yyyyMMdd").alias("game_id"), F.col("value").alias("epa"),
    )
    return rounded(personnel.decayed_rates(req, facts, 2.0, 25.0).select("request_id", "rate"))


_RATE_SQL = f"""WITH f AS (SELECT user_id, date_trunc('day', ts) AS k, sum(value) AS x, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
r AS (SELECT event_id AS request_id, user_id, ts AS cutoff FROM events WHERE event_type = 'purchase'),
h AS (SELECT r.request_id, f.x, f.n, row_number() OVER (PARTITION BY r.request_id ORDER BY f.k DESC) - 1 AS back
  FROM r JOIN f ON f.user_id = r.user_id AND f.k < r.cutoff),
w AS (SELECT request_id, sum(x * pow(2e0, -back / 2e0)) AS wx, sum(n * pow(2e0, -back / 2e0)) AS wn FROM h GROUP BY 1),
d AS (SELECT k, sum(x) AS x, sum(n) AS n FROM f GROUP BY 1),
c AS (SELECT k, sum(x) OVER (ORDER BY k) AS cx, sum(n) OVER (ORDER BY k) AS cn, lead(k) OVER (ORDER BY k) AS nxt FROM d)
SELECT r.request_id, {r6('(wx + 25 * cx / cn) / (wn + 25)')} AS rate FROM r LEFT JOIN w USING (request_id)
LEFT JOIN c ON c.k < r.cutoff AND (c.nxt >= r.cutoff OR c.nxt IS NULL)"""


def last_four_share(spark, sf_dir):
    """Mean supplier share of a nation's last four months, when present in all."""
    p = plays(spark, sf_dir).filter("season_type = 'REG'")
    month = F.expr("season * 12 + week").alias("kickoff_utc")
    shares = p.groupBy(F.col("posteam").alias("team_id"), F.col("defteam").alias("player_id"), month).agg(F.sum("quantity").alias("q"))
    total = shares.groupBy("team_id", "kickoff_utc").agg(F.sum("q").alias("t"))
    share = shares.join(total, ["team_id", "kickoff_utc"]).select("team_id", "player_id", F.col("kickoff_utc").alias("game_id"), (F.col("q") / F.col("t")).alias("share"))
    team = total.select("team_id", F.col("kickoff_utc").alias("game_id"), "kickoff_utc")
    req = shares.select("team_id", "player_id", F.col("kickoff_utc").alias("cutoff")).withColumn("request_id", F.expr("cutoff * 10000 + team_id * 100 + player_id"))
    return rounded(personnel.last_full_share(req, team, share).select("request_id", "lost_share"))


_SHARE_SQL = f"""WITH {PLAYS_SQL},
sh AS (SELECT posteam AS team_id, defteam AS player_id, season * 12 + week AS m, sum(quantity) AS q FROM plays WHERE season_type = 'REG' GROUP BY 1, 2, 3),
tt AS (SELECT team_id, m, sum(q) AS t, row_number() OVER (PARTITION BY team_id ORDER BY m) AS i FROM sh GROUP BY 1, 2),
s2 AS (SELECT sh.*, q / t AS share, i FROM sh JOIN tt USING (team_id, m))
SELECT a.m * 10000 + a.team_id * 100 + a.player_id AS request_id,
  {r6('CASE WHEN count(b.share) = 4 THEN avg(b.share) END')} AS lost_share
FROM s2 a LEFT JOIN s2 b ON b.team_id = a.team_id AND b.player_id = a.player_id AND b.i BETWEEN a.i - 4 AND a.i - 1 GROUP BY 1"""


def replacement_shock(spark, sf_dir):
    """Shock of every purchase as a request of its user's team."""
    e = table(spark, sf_dir, "events").withColumns(
        {"week": F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int"), "season": F.lit(2024), "team_id": F.col("user_id")}
    )
    first, second = F.col("user_id") * 10 + F.col("event_id") % 2, F.col("user_id") * 10 + 2 + F.col("event_id") % 2

    def of(kind):
        return e.filter(F.col("event_type") == kind)

    requests = of("purchase").select(F.col("event_id").alias("request_id"), "team_id", "season", "week", F.col("ts").alias("cutoff"))
    depth = of("view").select(
        "team_id", F.col("ts").alias("dt"), F.lit("QB").alias("position"),
        F.inline(F.array(
            F.struct(F.lit(1).alias("pos_rank"), first.alias("player_id")),
            F.struct(F.when(F.col("event_id") % 7 == 0, 3).otherwise(2).alias("pos_rank"), second.alias("player_id")),
        )),
    )
    statuses = of("error").select(
        "team_id", "season", "week", first.alias("player_id"), F.lit("QB").alias("position"),
        F.when(F.col("event_id") % 3 == 0, F.lit("Questionable")).otherwise(F.lit("Out")).alias("status"),
    )
    players = e.select("user_id").distinct().select(F.explode(F.array(*[F.col("user_id") * 10 + i for i in range(4)])).alias("player_id"))
    players = players.filter("player_id % 13 <> 0").withColumn("share_player_id", F.concat(F.lit("S"), F.col("player_id").cast("string")))
    team_games = of("signup").select("team_id", F.col("event_id").alias("game_id"), F.col("ts").alias("kickoff_utc"))
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    shares = of("signup").select("team_id", "event_id", "user_id", k).filter("(event_id + k) % 17 <> 0").select(
        "team_id", F.concat(F.lit("S"), (F.col("user_id") * 10 + F.col("k")).cast("string")).alias("share_player_id"), F.col("event_id").alias("game_id"),
        ((F.col("event_id") + F.col("k")) % 10 / 10).alias("share"),
    )
    facts = of("click").select((F.col("user_id") * 10 + F.col("event_id") % 4).alias("player_id"), F.col("event_id").alias("game_id"), F.col("ts").alias("kickoff_utc"), F.col("value").alias("epa"))
    out = personnel.replacement_shock(requests, depth, statuses, players, team_games, shares, facts, 4.0, 5.0)
    return rounded(out.select("request_id", "starter_player_id", "backup_player_id", "lost_share", "starter_rate", "backup_rate", "eligibility_status", "shock").withColumns(
        {c: F.col(c).cast("double") for c in ("starter_player_id", "backup_player_id")}
    ))


_SHOCK_SQL = f"""WITH e AS (SELECT *, CAST(floor(date_diff('day', TIMESTAMP '2024-01-01 00:00:00', date_trunc('day', ts)) / 7e0) AS INT) AS week FROM events),
r AS (SELECT event_id AS request_id, user_id, week, ts AS cutoff FROM e WHERE event_type = 'purchase'),
d AS (SELECT r.*, v.ts AS dt, v.event_id AS v, r.user_id * 10 + v.event_id % 2 AS id1, r.user_id * 10 + 2 + v.event_id % 2 AS id2b, v.event_id % 7 <> 0 AS two
  FROM r ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON v.user_id = r.user_id AND v.ts <= r.cutoff),
st AS (SELECT user_id, week, user_id * 10 + event_id % 2 AS pid, event_id % 3 <> 0 AS isout FROM e WHERE event_type = 'error'),
cov AS (SELECT DISTINCT user_id, week FROM st),
ec AS (SELECT user_id, week, pid, count(*) AS n FROM st WHERE isout GROUP BY 1, 2, 3),
sg AS (SELECT d.request_id, d.id1, s.event_id AS g, row_number() OVER (PARTITION BY d.request_id ORDER BY s.ts DESC, s.event_id DESC) AS rn FROM d JOIN e s ON s.event_type = 'signup' AND s.user_id = d.user_id AND s.ts < d.cutoff),
ls AS (SELECT request_id, avg(((g + id1 % 10) % 10) / 10e0) AS lost FROM sg WHERE rn <= 4 AND (g + id1 % 10) % 17 <> 0 AND id1 % 13 <> 0 GROUP BY 1 HAVING count(*) = 4),
ck AS (SELECT user_id * 10 + event_id % 4 AS pid, ts, event_id, value FROM e WHERE event_type = 'click'),
cum AS (SELECT ts, sum(value) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) / count(*) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS mu FROM ck),
asked AS (SELECT request_id, cutoff, id1 AS pid, 1 AS role FROM d UNION ALL SELECT request_id, cutoff, CASE WHEN two THEN id2b END, 2 FROM d),
h AS (SELECT a.request_id, a.role, c.value, row_number() OVER (PARTITION BY a.request_id, a.role ORDER BY c.ts DESC, c.event_id DESC) - 1 AS k FROM asked a JOIN ck c ON c.pid = a.pid AND c.ts < a.cutoff),
w AS (SELECT request_id, role, sum(value * pow(2e0, -k / 4e0)) AS wx, sum(pow(2e0, -k / 4e0)) AS wn FROM h GROUP BY 1, 2),
mu AS (SELECT DISTINCT r.request_id, c.mu FROM r ASOF LEFT JOIN cum c ON c.ts < r.cutoff),
rt AS (SELECT request_id, max(CASE WHEN role = 1 THEN (wx + 5 * mu) / (wn + 5) END) AS sr, max(CASE WHEN role = 2 THEN (wx + 5 * mu) / (wn + 5) END) AS br FROM w JOIN mu USING (request_id) GROUP BY 1),
f AS (SELECT d.request_id, id1, CASE WHEN two THEN id2b END AS id2, lost, sr, br, CASE WHEN dt IS NULL THEN 'INELIGIBLE_MISSING_DEPTH' WHEN NOT two THEN 'INELIGIBLE_AMBIGUOUS_DEPTH'
    WHEN cov.user_id IS NULL THEN 'INELIGIBLE_MISSING_INJURY_COVERAGE' WHEN ec.n IS NULL THEN 'NO_QUALIFYING_EVENT' WHEN ec.n <> 1 THEN 'INELIGIBLE_AMBIGUOUS_INJURY'
    WHEN id1 % 13 = 0 THEN 'INELIGIBLE_MISSING_STARTER_CROSSWALK' WHEN lost IS NULL THEN 'INELIGIBLE_MISSING_STARTER_VOLUME' WHEN sr IS NULL THEN 'INELIGIBLE_MISSING_STARTER_RATE'
    WHEN br IS NULL THEN 'INELIGIBLE_MISSING_BACKUP_RATE' ELSE 'ELIGIBLE_RESEARCH_ONLY' END AS status
  FROM d LEFT JOIN cov ON cov.user_id = d.user_id AND cov.week = d.week LEFT JOIN ec ON ec.user_id = d.user_id AND ec.week = d.week AND ec.pid = d.id1
  LEFT JOIN ls USING (request_id) LEFT JOIN rt USING (request_id))
SELECT request_id, {r6('CAST(id1 AS DOUBLE)')} AS starter_player_id, {r6('CAST(id2 AS DOUBLE)')} AS backup_player_id, {r6('lost')} AS lost_share, {r6('sr')} AS starter_rate, {r6('br')} AS backup_rate, status AS eligibility_status,
  {r6("CASE WHEN status = 'ELIGIBLE_RESEARCH_ONLY' THEN lost * (br - sr) WHEN status = 'NO_QUALIFYING_EVENT' THEN 0 END")} AS shock FROM f"""


def ranked_entities(spark, sf_dir):
    """Deterministic multi-key ranking of nations, from a compact aggregate."""
    t = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("bal"))
    order = [F.col("n").desc(), F.col("bal").desc(), F.col("s_nationkey")]
    return rounded(scan.row_numbers(t, order, "rank"))


def best_contract_per_exposure(spark, sf_dir):
    """Top five users by value, one event per (user, type) exposure."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    one = tmp.last_per_key(ev, ["user_id", "event_type"], ["value", "event_id"])
    return one.orderBy(F.col("value").desc(), "event_id").limit(5)


def cheapest_configuration(spark, sf_dir):
    """Argmin with an ordered tie-break tuple."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_discount", "l_tax").agg(F.avg("l_quantity").alias("score"))
    scored = li.withColumn("score", F.round("score", 1))
    best = scored.groupBy("l_returnflag").agg(
        F.min_by(F.struct("score", "l_discount", "l_tax"), F.struct("score", "l_discount", "l_tax")).alias("b")
    )
    return best.select("l_returnflag", "b.*")


QUERIES = {
    "known_schedule": known_schedule,
    "drifting_slices": drifting_slices,
    "first_write": first_write,
    "last_write": last_write,
    "distinct_members": distinct_members,
    "game_sequence": game_sequence,
    "member_continuity": member_continuity,
    "category_counts": category_counts,
    "line_movement": line_movement,
    "split_lags": split_lags,
    "latest_view_asof": latest_view,
    "interval_matches": matched_events,
    "tercile_edges": tercile_edges,
    "equal_count_bins": equal_bins,
    "decayed_rates": decayed_rates,
    "last_four_share": last_four_share,
    "replacement_shock": replacement_shock,
    "ranked_entities": ranked_entities,
    "best_per_exposure": best_contract_per_exposure,
    "cheapest_configuration": cheapest_configuration,
}

ORACLES = {
    "known_schedule": f"""WITH {PLAYS_SQL}, {GAMES_SQL},
      e AS (SELECT game_id, kickoff_dt, season, week, home_team AS team_id, away_team AS opponent_team_id, true AS is_home, home_score IS NOT NULL AND away_score IS NOT NULL AS done FROM games WHERE game_type = 'REG'
        UNION ALL SELECT game_id, kickoff_dt, season, week, away_team, home_team, false, home_score IS NOT NULL AND away_score IS NOT NULL FROM games WHERE game_type = 'REG'),
      n AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff_dt, game_id) AS rn FROM e WHERE kickoff_dt > TIMESTAMP '{_ASOF}'),
      s AS (SELECT * EXCLUDE (done) FROM e WHERE kickoff_dt < TIMESTAMP '{_ASOF}' AND done UNION ALL SELECT * EXCLUDE (done, rn) FROM n WHERE rn = 1)
      SELECT * FROM s WHERE game_id IN (SELECT game_id FROM s GROUP BY 1 HAVING count(*) = 2)""",
    "drifting_slices": """SELECT CASE WHEN year(o_orderdate) >= 1998 THEN o_orderstatus END AS o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
    "first_write": "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1",
    "last_write": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1",
    "distinct_members": "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
    "game_sequence": f"""WITH {ft.TEAM_GAMES_SQL} SELECT team_id, season, kickoff_dt, game_id,
      row_number() OVER (PARTITION BY team_id, season ORDER BY kickoff_dt, game_id) AS game_number,
      row_number() OVER (PARTITION BY team_id, season ORDER BY kickoff_dt DESC, game_id DESC) - 1 AS games_ago,
      row_number() OVER (PARTITION BY team_id, season ORDER BY kickoff_dt DESC, game_id DESC) <= 4 AS in_last_four FROM team_games""",
    "member_continuity": _CONT_SQL,
    "category_counts": """WITH s AS (SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(month(o_orderdate) AS INT) AS week, o_custkey % 25 AS team_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'QB' WHEN '2-HIGH' THEN 'G' WHEN '3-MEDIUM' THEN 'LB' ELSE 'CB' END AS p,
        CASE o_orderstatus WHEN 'F' THEN 'Out' WHEN 'O' THEN 'Questionable' ELSE 'Doubtful' END AS st FROM orders)
      SELECT season, week, team_id, count(*) FILTER (st IN ('Out', 'Doubtful') AND p = 'QB') AS qb_out_doubtful,
        count(*) FILTER (st IN ('Out', 'Doubtful') AND p IN ('C', 'G', 'T')) AS ol_out_doubtful,
        count(*) FILTER (st IN ('Out', 'Doubtful') AND p IN ('DE', 'DT', 'LB')) AS defensive_front_out_doubtful,
        count(*) FILTER (st IN ('Out', 'Doubtful') AND p IN ('CB', 'S')) AS secondary_out_doubtful,
        count(*) FILTER (st = 'Questionable') AS questionable_players FROM s GROUP BY 1, 2, 3""",
    "line_movement": """SELECT event_type, ts, event_id, value AS line, lag(value) OVER w AS previous_line, round(value - lag(value) OVER w, 6) + 0e0 AS line_movement
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    "split_lags": "SELECT event_type, CAST(year(ts) AS INT) AS season, ts, event_id, value, "
    + ", ".join(f"lag(ts, {k}) OVER w AS lag{k}_ts, lag(value, {k}) OVER w AS lag{k}_value" for k in range(1, 5))
    + ", " + " + ".join(f"CASE WHEN lag(value, {k}) OVER w IS NOT NULL THEN 1 ELSE 0 END" for k in range(1, 5)) + """ AS games_available
      FROM events WINDOW w AS (PARTITION BY event_type, year(ts) ORDER BY ts, event_id)""",
    "latest_view_asof": """SELECT l.event_id, l.user_id, l.ts, r.ts AS view_ts, r.event_id AS view_id, r.value AS view_value
      FROM (SELECT * FROM events WHERE event_type = 'purchase') l
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON r.user_id = l.user_id AND r.ts <= l.ts""",
    "interval_matches": """WITH m AS (SELECT c.event_id AS click_id, s.event_id AS signup_id,
        count(*) OVER (PARTITION BY c.event_id) AS a, count(*) OVER (PARTITION BY s.event_id) AS b
        FROM events c JOIN events s ON s.user_id = c.user_id AND abs(date_diff('microsecond', c.ts, s.ts)) <= 28800000000
        WHERE c.event_type = 'click' AND s.event_type = 'signup')
      SELECT click_id, signup_id FROM m WHERE a = 1 AND b = 1""",
    "tercile_edges": f"SELECT l_returnflag, {r6('quantile_cont(l_extendedprice, 1e0 / 3)')} AS q0, {r6('quantile_cont(l_extendedprice, 2e0 / 3)')} AS q1 FROM lineitem GROUP BY 1",
    "equal_count_bins": f"""SELECT CAST(bin AS INT) AS bin, count(*) AS rows, {r6('avg(edge)')} AS mean_edge, {r6('avg(outcome)')} AS observed_rate FROM (
      SELECT edge, outcome, ntile(5) OVER (ORDER BY edge, l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_partkey, l_quantity, l_shipdate, outcome) AS bin
      FROM (SELECT *, l_discount - l_tax AS edge, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS outcome FROM lineitem) y) x GROUP BY 1""",
    "decayed_rates": _RATE_SQL,
    "last_four_share": _SHARE_SQL,
    "replacement_shock": _SHOCK_SQL,
    "ranked_entities": f"""SELECT s_nationkey, n, {r6('bal')} AS bal, row_number() OVER (ORDER BY n DESC, bal DESC, s_nationkey) AS rank
      FROM (SELECT s_nationkey, count(*) AS n, sum(s_acctbal) AS bal FROM supplier GROUP BY 1) x""",
    "best_per_exposure": """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS rn FROM events) x
      WHERE rn = 1 ORDER BY value DESC, event_id LIMIT 5""",
    "cheapest_configuration": """SELECT l_returnflag, score, l_discount, l_tax FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score, l_discount, l_tax) AS rn FROM (
      SELECT l_returnflag, l_discount, l_tax, round(avg(l_quantity), 1) AS score FROM lineitem GROUP BY 1, 2, 3) y) x WHERE rn = 1""",
}
