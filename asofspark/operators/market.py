"""Two-sided market boards: flattening, contracts, consensus and selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import (
    ANCHOR_BOOK,
    ANCHOR_LINE_SHARE,
    CLOSE_WINDOW_EARLIEST,
    CLOSE_WINDOW_LATEST,
    DISLOCATION_POINTS,
    ELIGIBLE_CLOSE_STATUS,
    FRESHNESS_MINUTES,
    MARKETS,
    RETAIL_BOOKS,
    RETAIL_LINE_SHARE,
)
from asofspark.functions import prices as px
from asofspark.functions.scalars import col, first_reason, minutes_between
from asofspark.operators.scan import lags


@dataclass(frozen=True)
class Books:
    anchor: str = ANCHOR_BOOK
    retail: tuple[str, ...] = RETAIL_BOOKS

    @property
    def all(self) -> tuple[str, ...]:
        return (self.anchor, *self.retail)


def flatten_board(boards: DataFrame, books: Books = Books(), carry: tuple[str, ...] = ("snapshot_id", "retrieved_at_utc")) -> DataFrame:
    """Nested board rows to one quote per outcome, with fair probabilities.

    Only whitelisted books and the two known markets are kept. A market that
    does not have exactly two outcomes, or whose overround is not above one,
    is an error of the board: ``board_error`` names it and the prices of that
    market are null, so a caller may filter or raise.
    """
    books_x = boards.select(
        *carry, F.col("id").alias("provider_event_id"), "commence_time", "home_team", "away_team",
        F.explode("bookmakers").alias("_b"),
    ).filter(F.col("_b.key").isin(*books.all))
    markets_x = books_x.select("*", F.explode("_b.markets").alias("_m")).filter(F.col("_m.key").isin(*MARKETS))
    sized = markets_x.withColumn("_two", F.size("_m.outcomes") == 2)
    outcomes = sized.select("*", F.posexplode_outer("_m.outcomes").alias("_pos", "_o"))
    own = F.col("_o.price")
    other = F.when(F.col("_two"), F.when(F.col("_pos") == 0, F.col("_m.outcomes")[1]["price"]).otherwise(F.col("_m.outcomes")[0]["price"]))
    total = px.overround(own, other)
    selection = px.selection_key(F.col("_m.key"), F.col("_o.name"), F.col("home_team"))
    error = first_reason(
        (~F.col("_two"), "NOT_TWO_SIDED"),
        (own.isNull() | (own == 0) | other.isNull() | (other == 0), "PRICE_INVALID"),
        (selection.isNull(), "SELECTION_INVALID"),
        (total <= 1.0, "OVERROUND_INVALID"),
    )
    updated = F.coalesce("_m.last_update", "_b.last_update")
    return outcomes.select(
        *carry,
        "provider_event_id",
        F.col("commence_time").alias("commence_time_utc"),
        F.col("_b.key").alias("bookmaker_key"),
        F.coalesce("_b.title", "_b.key").alias("bookmaker_title"),
        F.when(F.col("_b.key") == books.anchor, F.lit("anchor")).otherwise(F.lit("retail")).alias("bookmaker_group"),
        F.col("_m.key").alias("market"),
        selection.alias("selection"),
        F.col("_o.point").alias("point"),
        px.canonical_line(F.col("_m.key"), selection, F.col("_o.point")).alias("canonical_line"),
        own.alias("american_price"),
        px.decimal_price(own).alias("decimal_price"),
        px.implied_probability(own).alias("implied_probability"),
        F.when(total > 1.0, px.implied_probability(own) / total).alias("vig_free_probability"),
        total.alias("overround"),
        updated.alias("source_updated_at_utc"),
        error.alias("board_error"),
    )


def fresh(updated: str | Column, retrieved: str | Column, minutes: float = FRESHNESS_MINUTES) -> Column:
    """0 <= retrieved - updated <= minutes; a missing time fails."""
    age = minutes_between(retrieved, updated)
    return F.coalesce((age >= 0) & (age <= minutes), F.lit(False))


def in_close_window(start: str | Column, at: str | Column, latest: float = CLOSE_WINDOW_LATEST, earliest: float = CLOSE_WINDOW_EARLIEST) -> Column:
    return minutes_between(start, at).between(latest, earliest)


def oriented(market: str | Column = "market", selection: str | Column = "selection") -> Column:
    return F.when(col(market) == "spreads", col(selection) == "HOME").otherwise(col(selection) == "OVER")


def consensus(
    quotes: DataFrame,
    keys: tuple[str, ...] = ("snapshot_id", "provider_event_id", "market"),
    books: Books = Books(),
    freshness_minutes: float | None = FRESHNESS_MINUTES,
) -> DataFrame:
    """Anchor/retail consensus per board market, as a single aggregate.

    Only fresh oriented quotes count; the update time comes from all quotes of
    the group. The line is blended even when points differ, the probability
    only when all points are equal.
    """
    live = oriented()
    if freshness_minutes is not None:
        live = live & fresh("source_updated_at_utc", "retrieved_at_utc", freshness_minutes)
    is_anchor = live & (F.col("bookmaker_key") == books.anchor)
    is_retail = live & F.col("bookmaker_key").isin(*books.retail)
    line, fair = F.col("canonical_line"), F.col("vig_free_probability")
    counted = is_anchor | is_retail
    slots = F.array(
        *[
            F.struct(
                F.lit(b).alias("book"),
                F.max(F.when(is_retail & (F.col("bookmaker_key") == b), line)).alias("line"),
            )
            for b in sorted(books.retail)
        ]
    )
    g = quotes.groupBy(*keys).agg(
        F.max(F.when(is_anchor, line)).alias("anchor_line"),
        F.avg(F.when(is_retail, line)).alias("retail_line_mean"),
        F.max(F.when(is_anchor, fair)).alias("anchor_vig_free_probability"),
        F.avg(F.when(is_retail, fair)).alias("retail_vig_free_probability"),
        F.count_if(is_anchor).alias("_anchors"),
        F.count_if(is_retail).alias("retail_books_count"),
        (F.max(F.when(counted, line)) - F.min(F.when(counted, line))).alias("_spread"),
        F.max("source_updated_at_utc").alias("source_updated_at_utc"),
        slots.alias("_slots"),
    )
    both = (F.col("_anchors") > 0) & (F.col("retail_books_count") > 0)
    same = F.coalesce(F.col("_spread") < 1e-9, F.lit(False))
    return g.select(
        *keys,
        "anchor_line",
        "retail_line_mean",
        F.when(both, ANCHOR_LINE_SHARE * F.col("anchor_line") + RETAIL_LINE_SHARE * F.col("retail_line_mean"))
        .otherwise(F.col("anchor_line"))
        .alias("consensus_line"),
        "anchor_vig_free_probability",
        "retail_vig_free_probability",
        F.when(
            both & same,
            ANCHOR_LINE_SHARE * F.col("anchor_vig_free_probability")
            + RETAIL_LINE_SHARE * F.col("retail_vig_free_probability"),
        ).alias("consensus_probability"),
        same.alias("same_point"),
        "retail_books_count",
        first_reason(
            ((F.col("_anchors") == 0) & (F.col("retail_books_count") > 0), "RETAIL_ONLY"),
            (F.col("_anchors") == 0, "UNAVAILABLE"),
            (F.col("retail_books_count") == 0, "NO_RETAIL"),
            (F.col("retail_books_count") < 2, "DEGRADED_RETAIL"),
            (~same, "INCOMPARABLE_POINTS"),
            otherwise="VALID",
        ).alias("status"),
        F.transform(
            F.filter("_slots", lambda s: F.abs(s["line"] - F.col("anchor_line")) >= DISLOCATION_POINTS),
            lambda s: s["book"],
        ).alias("dislocated_books"),
        "source_updated_at_utc",
    )


def anchor_contract(
    quotes: DataFrame,
    keys: tuple[str, ...] = ("snapshot_id", "provider_event_id", "market"),
    books: Books = Books(),
    max_age_minutes: float = FRESHNESS_MINUTES,
) -> DataFrame:
    """Validity of the anchor's two-sided contract with the first failing reason."""
    name = books.anchor.upper()
    anchor = F.col("bookmaker_key") == books.anchor
    side = oriented()
    opposite = F.when(F.col("market") == "spreads", F.col("selection") == "AWAY").otherwise(F.col("selection") == "UNDER")
    updated, seen = F.col("source_updated_at_utc"), F.col("retrieved_at_utc")

    def one(cond: Column, value: str) -> Column:
        return F.max(F.when(anchor & cond, F.col(value)))

    g = quotes.groupBy(*keys).agg(
        F.count_if(anchor).alias("_n"),
        F.count_if(anchor & side).alias("_n1"),
        F.count_if(anchor & opposite).alias("_n2"),
        one(side, "canonical_line").alias("_l1"),
        one(opposite, "canonical_line").alias("_l2"),
        one(side, "american_price").alias("_p1"),
        one(opposite, "american_price").alias("_p2"),
        one(side, "vig_free_probability").alias("_f1"),
        one(side, "overround").alias("_o1"),
        F.min(F.when(anchor, F.col("overround"))).alias("_omin"),
        F.count_if(anchor & updated.isNull()).alias("_nou"),
        F.min(F.when(anchor, updated)).alias("_oldest"),
        F.max(F.when(anchor, updated)).alias("_newest"),
        F.max(seen).alias("snapshot_retrieved_at_utc"),
    )
    reason = first_reason(
        (F.col("_n") != 2, f"{name}_TWO_SIDED_CONTRACT_MISSING"),
        ((F.col("_n1") != 1) | (F.col("_n2") != 1), f"{name}_SELECTIONS_INVALID"),
        (F.coalesce(F.abs(F.col("_l1") - F.col("_l2")) > 1e-9, F.lit(True)), f"{name}_POINTS_DIFFER"),
        (F.coalesce(F.col("_omin") <= 1.0, F.lit(True)), f"{name}_OVERROUND_INVALID"),
        (F.col("_nou") > 0, f"{name}_UPDATE_TIME_MISSING"),
        (F.col("_newest") > F.col("snapshot_retrieved_at_utc"), f"{name}_UPDATE_AFTER_SNAPSHOT"),
        (minutes_between("snapshot_retrieved_at_utc", "_oldest") > max_age_minutes, f"{name}_QUOTE_STALE"),
    )
    priced = reason.isNull() | reason.isin(
        f"{name}_UPDATE_TIME_MISSING", f"{name}_UPDATE_AFTER_SNAPSHOT", f"{name}_QUOTE_STALE"
    )
    timed = priced & (F.col("_nou") == 0)
    return g.withColumn("reason", reason).select(
        *keys,
        "snapshot_retrieved_at_utc",
        F.col("reason").isNull().alias("contract_valid"),
        "reason",
        F.when(priced, F.col("_l1")).alias("anchor_line"),
        F.when(priced, F.col("_p1")).alias("anchor_orientation_price"),
        F.when(priced, F.col("_p2")).alias("anchor_other_price"),
        F.when(priced, F.col("_f1")).alias("anchor_orientation_no_vig_probability"),
        F.when(priced, F.col("_o1")).alias("anchor_overround"),
        F.when(timed, F.col("_newest")).alias("anchor_updated_at_utc"),
    )


def complete_contracts(
    quotes: DataFrame,
    keys: tuple[str, ...] = ("snapshot_id", "provider_event_id", "bookmaker_key", "market", "canonical_line"),
    max_age_minutes: float = FRESHNESS_MINUTES,
) -> DataFrame:
    """Contracts with both selections once, fresh, overround > 1 and fair sum 1."""
    first = oriented()
    second = F.when(F.col("market") == "spreads", F.col("selection") == "AWAY").otherwise(F.col("selection") == "UNDER")
    g = quotes.filter(F.col("canonical_line").isNotNull() & F.col("market").isin(*MARKETS)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(first).alias("_n1"),
        F.count_if(second).alias("_n2"),
        F.min("overround").alias("overround"),
        F.sum("vig_free_probability").alias("fair_sum"),
        F.min("source_updated_at_utc").alias("_oldest"),
        F.max("source_updated_at_utc").alias("_newest"),
        F.count("source_updated_at_utc").alias("_times"),
        F.max("retrieved_at_utc").alias("retrieved_at_utc"),
        F.max(F.when(first, F.struct("american_price", "point", "vig_free_probability"))).alias("orientation"),
        F.max(F.when(second, F.struct("american_price", "point", "vig_free_probability"))).alias("other"),
    )
    ok = (
        (F.col("_n") == 2)
        & (F.col("_n1") == 1)
        & (F.col("_n2") == 1)
        & (F.col("_times") == 2)
        & (F.col("_newest") <= F.col("retrieved_at_utc"))
        & (minutes_between("retrieved_at_utc", "_oldest") <= max_age_minutes)
        & (F.col("overround") > 1.0)
        & (F.abs(F.col("fair_sum") - 1.0) <= 1e-9)
    )
    return g.filter(ok).drop("_n", "_n1", "_n2", "_oldest", "_newest", "_times")


def canonical_predictions(
    predictions: DataFrame,
    keys: tuple[str, ...] = ("game_id", "market"),
    latest: float = CLOSE_WINDOW_LATEST,
    earliest: float = CLOSE_WINDOW_EARLIEST,
    max_age_minutes: float = FRESHNESS_MINUTES,
) -> DataFrame:
    """Latest valid decision row per key; ties go to the larger prediction id."""
    age = minutes_between("snapshot_retrieved_at_utc", "anchor_updated_at_utc")
    valid = predictions.filter(
        (F.col("snapshot_purpose") == "DECISION")
        & (F.col("eligibility_status") == ELIGIBLE_CLOSE_STATUS)
        & in_close_window("kickoff_utc", "snapshot_retrieved_at_utc", latest, earliest)
        & (F.col("prediction_created_at_utc") >= F.col("snapshot_retrieved_at_utc"))
        & (F.col("prediction_created_at_utc") < F.col("kickoff_utc"))
        & (age >= 0)
        & (age <= max_age_minutes)
        & F.col("anchor_line").isNotNull()
        & F.col("anchor_orientation_no_vig_probability").isNotNull()
        & F.col("calibrated_non_push_win_probability").isNotNull()
    )
    rest = [c for c in valid.columns if c not in keys]
    best = valid.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("snapshot_retrieved_at_utc", "prediction_id")).alias("_r")
    )
    return best.select(*keys, "_r.*")


def canonical_closes(
    quotes: DataFrame,
    keys: tuple[str, ...] = ("game_id", "market"),
    books: Books = Books(),
    latest: float = CLOSE_WINDOW_LATEST,
    earliest: float = CLOSE_WINDOW_EARLIEST,
    max_age_minutes: float = FRESHNESS_MINUTES,
) -> DataFrame:
    """Latest valid closing contract per key, from market data alone."""
    closing = quotes.filter(F.col("snapshot_purpose") == "CLOSE")
    contracts = anchor_contract(
        closing, ("snapshot_id", "provider_event_id", *keys, "kickoff_utc"), books, max_age_minutes
    )
    valid = contracts.filter(
        "contract_valid"
    ).filter(in_close_window("kickoff_utc", "snapshot_retrieved_at_utc", latest, earliest))
    rest = [c for c in valid.columns if c not in (*keys, "contract_valid", "reason")]
    best = valid.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("snapshot_retrieved_at_utc", "snapshot_id")).alias("_r")
    )
    return best.select(*keys, "_r.*")


def line_movement(quotes: DataFrame, keys: list[str], ts: str, line: str, tie: str | None = None) -> DataFrame:
    """Change of the line against the previous snapshot of the same contract.

    A contract with very many snapshots is split over time.
    """
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    moved = lags(quotes, keys, order, [line], 1, lambda k, c: "previous_line")
    return moved.withColumn("line_movement", F.col(line) - F.col("previous_line"))
