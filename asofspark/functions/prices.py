"""Two-sided price arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofspark.fixed_values import KEY_NUMBERS, PRIMARY_KEY_NUMBERS
from asofspark.functions.scalars import col, first_reason


def decimal_price(american: str | Column) -> Column:
    """American price to decimal; a zero price gives null."""
    p = col(american).cast("double")
    return F.when(p < 0, 1.0 + F.lit(100.0) / F.abs(p)).when(p > 0, 1.0 + p / 100.0)


def implied_probability(american: str | Column) -> Column:
    p = col(american).cast("double")
    return F.when(p < 0, -p / (F.lit(100.0) - p)).when(p > 0, F.lit(100.0) / (F.lit(100.0) + p))


def net_profit(american: str | Column) -> Column:
    p = col(american).cast("double")
    return F.when(p > 0, p / 100.0).when(p < 0, F.lit(100.0) / F.abs(p))


def break_even(american: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + net_profit(american))


def overround(first: str | Column, second: str | Column) -> Column:
    return implied_probability(first) + implied_probability(second)


def fair_probability(first: str | Column, second: str | Column, require_overround: bool = False) -> Column:
    """Share of the first side after removing the margin.

    ``require_overround`` rejects books at or below 1 (null); the plain form is
    used for training matrices where only missing or zero prices are rejected.
    """
    total = overround(first, second)
    share = implied_probability(first) / total
    return F.when(total > 1.0, share) if require_overround else share


def canonical_line(market: str | Column, selection: str | Column, point: str | Column) -> Column:
    """Spread points turned to the home orientation; totals unchanged."""
    x = col(point)
    return F.when((col(market) == "spreads") & (col(selection) == "HOME"), -x).otherwise(x)


def selection_key(market: str | Column, name: str | Column, home_name: str | Column) -> Column:
    upper = F.upper(col(name))
    side = F.when(col(name) == col(home_name), F.lit("HOME")).otherwise(F.lit("AWAY"))
    return F.when(col(market) == "spreads", side).when(upper.isin("OVER", "UNDER"), upper)


def expected_roi(p_win: str | Column, p_loss: str | Column, net: str | Column) -> Column:
    return col(p_win) * col(net) - col(p_loss)


def contract_probabilities(p_non_push: str | Column, p_push: str | Column) -> tuple[Column, Column]:
    """(win, loss) of a contract whose push mass is split off first."""
    live = F.lit(1.0) - col(p_push)
    return live * col(p_non_push), live * (F.lit(1.0) - col(p_non_push))


def signed_keys(keys: tuple[int, ...] = KEY_NUMBERS) -> list[int]:
    return sorted(s * k for k in keys for s in (-1, 1))


def crossed_keys(decision: str | Column, closing: str | Column, keys: tuple[int, ...] = KEY_NUMBERS) -> Column:
    """Signed keys strictly between two lines; touched keys if none is crossed."""
    a, b = col(decision), col(closing)
    low, high = F.least(a, b), F.greatest(a, b)
    domain = F.array(*[F.lit(k) for k in signed_keys(keys)])
    crossed = F.filter(domain, lambda k: (k > low) & (k < high))
    touched = F.filter(domain, lambda k: (F.abs(a - k) <= 1e-9) | (F.abs(b - k) <= 1e-9))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(crossed) > 0, crossed).otherwise(touched))


def key_movement(
    market: str | Column,
    decision: str | Column,
    closing: str | Column,
    keys: tuple[int, ...] = KEY_NUMBERS,
    primary: tuple[int, ...] = PRIMARY_KEY_NUMBERS,
) -> Column:
    """Label of the movement between two lines with respect to the key numbers."""
    a, b = col(decision), col(closing)
    low, high = F.least(a, b), F.greatest(a, b)

    def any_key(test, subset) -> Column:
        return F.exists(F.array(*[F.lit(k) for k in signed_keys(subset)]), test)

    def crosses(k):
        return (k > low) & (k < high)

    def touches(k):
        return (F.abs(a - k) <= 1e-9) | (F.abs(b - k) <= 1e-9)

    return first_reason(
        (a.isNull() | b.isNull(), "UNAVAILABLE"),
        (col(market) != "spreads", "NOT_APPLICABLE"),
        (any_key(crosses, primary), "CROSSED_PRIMARY_KEY"),
        (any_key(crosses, keys), "CROSSED_KEY"),
        (any_key(touches, primary), "TOUCHED_PRIMARY_KEY"),
        (any_key(touches, keys), "TOUCHED_KEY"),
        otherwise="NO_KEY_CROSSING",
    )


def signal_source(weight: str | Column) -> Column:
    return F.when(col(weight) == 0.0, F.lit("MARKET_CALIBRATION_ONLY")).otherwise(F.lit("FOOTBALL_ADJUSTED"))


def direction(selection: str | Column, weighted_adjustment: str | Column) -> Column:
    """Whether a signed adjustment supports or opposes the selection."""
    positive = col(selection).isin("HOME", "OVER")
    adj = col(weighted_adjustment)
    return first_reason(
        (adj == 0.0, "NEUTRAL"),
        (positive == (adj > 0.0), "SUPPORTS_SELECTION"),
        otherwise="OPPOSES_SELECTION",
    )
