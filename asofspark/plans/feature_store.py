"""Facts and schedule to a published lag store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.operators import checks as ck
from asofspark.operators import observe as obs
from asofspark.operators import schedule as sched
from asofspark.operators import temporal as tmp
from asofspark.sources.publish import publish


class LeakageError(ValueError):
    """A feature row would see its own time or later."""


def lag_store(
    facts: DataFrame,
    games: DataFrame,
    as_of: Column,
    metrics: list[obs.Metric] = obs.BASE_METRICS,
    keep: str | None = obs.PLAYED,
    continuity: DataFrame | None = None,
    statuses: DataFrame | None = None,
) -> DataFrame:
    """Schedule known at ``as_of``, observations and strict lags.

    ``continuity`` adds share-continuity metrics per (season, game_id,
    team_id); ``statuses`` adds diagnostic counters that are carried along but
    never lagged into the model.
    """
    observed = obs.observe(obs.regular_facts(facts), metrics, keep=keep)
    rows = sched.known_schedule(games.filter("game_type = 'REG'"), as_of, ["season", "week"])
    team = rows.join(observed, ["game_id", "season", "week", "team_id"], "left")
    names = obs.names(metrics)
    if continuity is not None:
        extra = [c for c in continuity.columns if c not in ("season", "game_id", "team_id")]
        team, names = team.join(continuity, ["season", "game_id", "team_id"], "left"), [*names, *extra]
    if statuses is not None:
        team = team.join(obs.category_counts(statuses), ["season", "week", "team_id"], "left")
    return tmp.build_lags(team, names)


def require_no_leak(lags: DataFrame) -> DataFrame:
    """Fail unless every lag lies before its row; run on every write."""
    bad = ck.lag_boundaries(lags).filter("violations > 0").collect()
    if bad:
        raise LeakageError("; ".join(f"{r['check_id']}: {r['violations']}" for r in bad))
    return lags


def write_lag_store(lags: DataFrame, path: str, version: str) -> DataFrame:
    """Publish the lag store; the checks run on the staged files before the manifest row."""
    return publish(
        lags, path, version, partition_by=["season"],
        checks=lambda staged: ck.all_checks(
            ck.lag_boundaries(staged), ck.duplicate_keys(staged, "lags", ["game_id", "team_id"]), ck.group_size(staged, "lags", ["game_id"])
        ),
    )


def through_week_violations(games: DataFrame, as_of: Column, through_week: int, season: int) -> DataFrame:
    """Completed games of the season beyond the requested week."""
    done = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return games.filter(
        (F.col("season") == season) & (F.col("game_type") == "REG") & (F.col("week") > through_week)
        & (F.col("kickoff_dt") < as_of) & done
    )
