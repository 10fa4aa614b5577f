"""Replacement shock: who is out, who replaces them, and what that is worth.

Everything is computed for a batch of requests (entity, cutoff) at once, with
as-of joins; nothing loops over requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.functions.scalars import first_reason
from asofspark.operators.asof import asof_join, crosswalk
from asofspark.operators.scan import lags, row_numbers, running_totals


def decayed_rates(
    requests: DataFrame,
    facts: DataFrame,
    half_life: float,
    prior_strength: float,
    member: str = "player_id",
    cutoff: str = "cutoff",
    request_id: str = "request_id",
    game: str = "game_id",
    ts: str = "kickoff_utc",
    value: str = "epa",
    out: str = "rate",
) -> DataFrame:
    """(Σ w·sum + s·μ) / (Σ w·n + s) per request, over games strictly before the cutoff.

    w = 2^(-k / half_life) for the k-th most recent game of the member and μ is
    the mean of all facts before the cutoff. The decayed sums are running sums
    per member and block of ``500 * half_life`` games (Σ x·2^(j/h), scaled back by
    2^(-j/h)), so that a request needs one as-of lookup instead of a join to its
    whole history. The decayed totals of the two blocks before are carried in;
    older ones weigh under 2^-1000. So a history may have any length, and no
    window holds more than a block.
    """
    games = facts.filter(F.col(value).isNotNull()).groupBy(member, game, ts).agg(
        F.sum(value).alias("_x"), F.count(F.lit(1)).alias("_n")
    )
    h, size = F.lit(float(half_life)), max(1, int(500 * half_life))
    numbered = row_numbers(games, [F.col(ts), F.col(game)], "_i", [member])
    numbered = numbered.withColumns({"_block": F.floor((F.col("_i") - 1) / size), "_j": (F.col("_i") - 1) % size})
    upto = Window.partitionBy(member, "_block").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    grow = F.pow(F.lit(2.0), F.col("_j") / h)
    at_end = F.pow(F.lit(2.0), (F.col("_j") - (size - 1)) / h)
    blocks = numbered.groupBy(member, "_block").agg(F.sum(F.col("_x") * at_end).alias("_bx"), F.sum(F.col("_n") * at_end).alias("_bn"))
    earlier = Window.partitionBy(member).orderBy("_block")
    fade = 2.0 ** (-size / float(half_life))
    carried = blocks.select(
        member,
        "_block",
        *[(F.coalesce(F.lag(c, 1).over(earlier), F.lit(0.0)) + fade * F.coalesce(F.lag(c, 2).over(earlier), F.lit(0.0))).alias(f"{c}_in") for c in ("_bx", "_bn")],
    )
    shrink = F.pow(F.lit(2.0), -(F.col("_j") + 1) / h)
    summed = numbered.withColumns({"_lx": F.sum(F.col("_x") * grow).over(upto) / grow, "_ln": F.sum(F.col("_n") * grow).over(upto) / grow})
    history = summed.join(carried, [member, "_block"]).select(
        member,
        F.col(ts).alias("_seen"),
        F.col("_i"),
        (F.col("_lx") + F.col("_bx_in") * shrink).alias("_wx"),
        (F.col("_ln") + F.col("_bn_in") * shrink).alias("_wn"),
    )
    mine = asof_join(requests, history, [member], cutoff, "_seen", ["_wx", "_wn"], request_id, False, ["_i"])
    moments = games.groupBy(ts).agg(F.sum("_x").alias("_x"), F.sum("_n").alias("_n"))
    totals = running_totals(moments, [F.col(ts)], {"_cx": F.col("_x"), "_cn": F.col("_n")}).select(
        F.col(ts).alias("_at"), "_cx", "_cn"
    )
    full = asof_join(mine, totals, [], cutoff, "_at", ["_cx", "_cn"], request_id, False)
    s = F.lit(float(prior_strength))
    rate = F.try_divide(F.col("_wx") + s * F.try_divide(F.col("_cx"), F.col("_cn")), F.col("_wn") + s)
    return full.select(*requests.columns, rate.alias(out))


def last_full_share(
    requests: DataFrame,
    team_games: DataFrame,
    shares: DataFrame,
    entity: str = "team_id",
    member: str = "player_id",
    cutoff: str = "cutoff",
    request_id: str = "request_id",
    game: str = "game_id",
    ts: str = "kickoff_utc",
    share: str = "share",
    games: int = 4,
    out: str = "lost_share",
) -> DataFrame:
    """Mean share over the entity's last ``games`` completed games before the cutoff.

    Null unless all of those games exist and the member has a share in each.
    """
    # an entity with very many games is split over time
    named = team_games.select(entity, F.col(ts).alias("_seen"), F.col(game).alias("_g"), F.col(game).alias("_g0"))
    recent = lags(named, [entity], [F.col("_seen"), F.col("_g")], ["_g"], games - 1, lambda k, c: f"_g{k}")
    picks = [f"_g{k}" for k in range(games)]
    looked = asof_join(requests, recent, [entity], cutoff, "_seen", picks, request_id, False, ["_g"])
    one = looked.select(request_id, entity, member, F.explode(F.array(*picks)).alias(game)).filter(F.col(game).isNotNull())
    held = one.join(shares.select(entity, member, game, share), [entity, member, game])
    mean = held.groupBy(request_id).agg(
        F.when((F.count(F.lit(1)) == games) & (F.count(share) == games), F.avg(share)).alias(out)
    )
    return requests.join(mean, request_id, "left")


def depth_as_of(requests: DataFrame, depth: DataFrame, position: str, entity: str = "team_id", cutoff: str = "cutoff", request_id: str = "request_id") -> DataFrame:
    """First and second of the latest depth snapshot at or before the cutoff."""

    def rank(r: int) -> list[Column]:
        mine = F.col("pos_rank") == r
        return [F.count_if(mine).alias(f"_n{r}"), F.max(F.when(mine, F.col("player_id"))).alias(f"_id{r}")]

    snaps = depth.filter(F.col("position") == position).groupBy(entity, "dt").agg(*rank(1), *rank(2))
    return asof_join(requests, snaps, [entity], cutoff, "dt", ["_n1", "_id1", "_n2", "_id2"], request_id)


def replacement_shock(
    requests: DataFrame,
    depth: DataFrame,
    statuses: DataFrame,
    players: DataFrame,
    team_games: DataFrame,
    shares: DataFrame,
    facts: DataFrame,
    half_life: float,
    prior_strength: float,
    position: str = "QB",
    out_status: str = "Out",
) -> DataFrame:
    """share x (backup rate - starter rate) per request, with an eligibility code.

    requests: request_id, team_id, season, week, cutoff
    depth: team_id, dt, position, pos_rank, player_id
    statuses: team_id, season, week, player_id, position, status
    players: player_id, share_player_id (a crosswalk)
    team_games: team_id, game_id, kickoff_utc of completed games
    shares: team_id, share_player_id, game_id, share
    facts: player_id, game_id, kickoff_utc, epa

    No qualifying event is a shock of zero; a qualifying event with incomplete
    evidence is null.
    """
    req = requests.select("request_id", "team_id", "season", "week", "cutoff")
    who = depth_as_of(req, depth, position)
    covered = statuses.groupBy("team_id", "season", "week").agg(F.lit(True).alias("_covered"))
    events = (
        statuses.filter((F.col("position") == position) & (F.col("status") == out_status))
        .groupBy("team_id", "season", "week", F.col("player_id").alias("_id1"))
        .agg(F.count(F.lit(1)).alias("_events"))
    )
    pairs = crosswalk(players, "player_id", "share_player_id")
    base = (
        who.join(covered, ["team_id", "season", "week"], "left")
        .join(events, ["team_id", "season", "week", "_id1"], "left")
        .join(pairs.withColumnRenamed("player_id", "_id1"), "_id1", "left")
    )
    volume = last_full_share(
        base.filter(F.col("share_player_id").isNotNull()).select("request_id", "team_id", "share_player_id", "cutoff"),
        team_games, shares, member="share_player_id",
    ).select("request_id", "lost_share")
    asked = base.select("request_id", "cutoff", F.explode(F.array(
        F.struct(F.lit("starter").alias("role"), F.col("_id1").alias("player_id")),
        F.struct(F.lit("backup").alias("role"), F.col("_id2").alias("player_id")),
    )).alias("_p")).select(
        F.concat_ws("|", F.col("request_id").cast("string"), "_p.role").alias("_rid"), "request_id", "cutoff", "_p.*"
    )
    rated = decayed_rates(asked, facts, half_life, prior_strength, request_id="_rid")
    rates = rated.groupBy("request_id").agg(
        F.max(F.when(F.col("role") == "starter", F.col("rate"))).alias("starter_rate"),
        F.max(F.when(F.col("role") == "backup", F.col("rate"))).alias("backup_rate"),
    )
    full = base.join(volume, "request_id", "left").join(rates, "request_id", "left")
    status = first_reason(
        (F.col("dt").isNull(), "INELIGIBLE_MISSING_DEPTH"),
        ((F.col("_n1") != 1) | (F.col("_n2") != 1), "INELIGIBLE_AMBIGUOUS_DEPTH"),
        (F.col("_id1").isNull() | F.col("_id2").isNull(), "INELIGIBLE_MISSING_DEPTH_ID"),
        (F.col("_covered").isNull(), "INELIGIBLE_MISSING_INJURY_COVERAGE"),
        (F.col("_events").isNull(), "NO_QUALIFYING_EVENT"),
        (F.col("_events") != 1, "INELIGIBLE_AMBIGUOUS_INJURY"),
        (F.col("share_player_id").isNull(), "INELIGIBLE_MISSING_STARTER_CROSSWALK"),
        (F.col("lost_share").isNull(), "INELIGIBLE_MISSING_STARTER_VOLUME"),
        (F.col("starter_rate").isNull(), "INELIGIBLE_MISSING_STARTER_RATE"),
        (F.col("backup_rate").isNull(), "INELIGIBLE_MISSING_BACKUP_RATE"),
        otherwise="ELIGIBLE_RESEARCH_ONLY",
    )
    graded = full.withColumn("eligibility_status", status)
    live = F.col("eligibility_status") == "ELIGIBLE_RESEARCH_ONLY"
    return graded.select(
        "request_id", "team_id", "season", "week", "cutoff",
        F.col("_id1").alias("starter_player_id"), F.col("_id2").alias("backup_player_id"),
        "lost_share", "starter_rate", "backup_rate", "eligibility_status",
        F.when(live, F.col("lost_share") * (F.col("backup_rate") - F.col("starter_rate")))
        .when(F.col("eligibility_status") == "NO_QUALIFYING_EVENT", F.lit(0.0))
        .alias("shock"),
    )


def game_difference(home: str | Column, away: str | Column) -> Column:
    """Home minus away; null when either side is null."""
    h = F.col(home) if isinstance(home, str) else home
    a = F.col(away) if isinstance(away, str) else away
    return h - a
