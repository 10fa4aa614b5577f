"""Event schedules: unpivoting, de-duplication and the as-of cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.operators.temporal import first_per_key, last_per_key


def entity_rows(games: DataFrame, carry: list[str], home: str = "home_team", away: str = "away_team") -> DataFrame:
    """One game row to two entity rows in a single scan."""

    def side(me: str, other: str, is_home: bool) -> Column:
        return F.struct(
            F.col(me).alias("team_id"), F.col(other).alias("opponent_team_id"), F.lit(is_home).alias("is_home")
        )

    sides = F.explode(F.array(side(home, away, True), side(away, home, False)))
    return games.select(*carry, sides.alias("_s")).select(*carry, "_s.*")


def union_slices(slices: list[DataFrame]) -> DataFrame:
    """Union of yearly slices whose columns drifted; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slices)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(rows, keys, order)


def last_write_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The latest record of each primary key, by an explicit ingest sequence."""
    return last_per_key(rows, keys, [sequence])


def known_schedule(
    games: DataFrame,
    as_of: Column,
    carry: list[str],
    ts: str = "kickoff_dt",
    game: str = "game_id",
    completed: Column | None = None,
) -> DataFrame:
    """Completed history before ``as_of`` plus each entity's next game.

    A next game counts only when it is next for both sides; a game that has
    started without a result is in neither part. Exactly two rows per game.
    """
    done = completed if completed is not None else F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    rows = entity_rows(games.withColumn("_done", done), list(dict.fromkeys([game, ts, *carry, "_done"])))
    history = rows.filter((F.col(ts) < as_of) & F.col("_done"))
    upcoming = first_per_key(rows.filter(F.col(ts) > as_of), ["team_id"], [ts, game])
    both = history.unionByName(upcoming)
    sides = F.count(F.lit(1)).over(Window.partitionBy(game))
    return both.withColumn("_sides", sides).filter(F.col("_sides") == 2).drop("_sides", "_done")
