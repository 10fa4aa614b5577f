"""Empirical residual distributions: win, push and loss at a line.

Probabilities are counts of residuals above, at and below a threshold. They
are taken from one ordered scan over residuals and thresholds together, split
over ranges, so neither the residuals nor the rows to score need fit anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import KEY_NUMBERS, MIN_STRATUM_ROWS, SHRINKAGE
from asofspark.functions.prices import signed_keys
from asofspark.functions.scalars import logistic, logit
from asofspark.operators.scan import exact_quantiles, running_totals
from asofspark.session import checkpointed

GLOBAL = -1


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def counts_up_to(points: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, at_most, below) for every distinct probed value: how many points of its key lie up to and below it.

    points: keys, value, cnt. probes: keys, value. Points and probes are merged to
    distinct values map-side before the ordered scan, so a value that is asked
    for very often, or that very many points share, is one row of it and the order is total.
    """
    q = probes.select(*keys, "value", F.lit(0).cast("bigint").alias("cnt"), F.lit(1).alias("_asked"))
    stacked = points.select(*keys, "value", "cnt", F.lit(0).alias("_asked")).unionByName(q)
    merged = stacked.groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"), F.max("_asked").alias("_asked"))
    ranked = running_totals(merged, [F.col("value")], {"at_most": F.col("cnt")}, keys)
    return ranked.filter("_asked = 1").select(*keys, "value", "at_most", (F.col("at_most") - F.col("cnt")).alias("below"))


@dataclass
class ResidualModel:
    """Residual points, per-stratum profiles and stratum edges, as tables."""

    sets: list[str]
    points: DataFrame
    profile: DataFrame
    edges: DataFrame
    keys: tuple[int, ...]


def _strata_value(value: Column, absolute: Column) -> Column:
    return F.when(absolute, F.abs(value)).otherwise(value)


def _stratum(value: Column) -> Column:
    return (F.when(value > F.col("q0"), 1).otherwise(0) + F.when(value > F.col("q1"), 1).otherwise(0)).cast("int")


def fit_distribution(
    rows: DataFrame,
    sets: list[str],
    actual: str = "target",
    projection: str = "final",
    stratum: str = "line",
    key_numbers: tuple[int, ...] = KEY_NUMBERS,
    keyed: Column | None = None,
) -> ResidualModel:
    """Residual model of every set (market, fold, candidate) at once.

    ``keyed`` marks the rows whose market uses key numbers and absolute
    strata; by default that is ``market = 'spreads'``.
    """
    keyed = keyed if keyed is not None else F.col("market") == "spreads"
    base = rows.select(
        *sets, F.col(actual).alias("_a"), (F.col(actual) - F.col(projection)).alias("value"),
        _strata_value(F.col(stratum), keyed).alias("_sv"), keyed.alias("_keyed"),
    ).dropna(subset=["_a", "value", "_sv"])
    edges = exact_quantiles(base, "_sv", [1.0 / 3.0, 2.0 / 3.0], sets)
    located = base.join(edges, sets).withColumn("stratum", F.explode(F.array(F.lit(GLOBAL), _stratum(F.col("_sv")))))
    signed = signed_keys(key_numbers)
    on_key = F.col("_keyed") & F.col("_a").isin(*[float(k) for k in signed])
    masses = F.array(*[F.avg(F.when(F.col("_keyed") & is_close(F.col("_a"), F.lit(float(k))), 1.0).otherwise(0.0)) for k in signed])
    profile = located.groupBy(*sets, "stratum").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~on_key).alias("n_plain"),
        masses.alias("mass"),
    ).filter(F.col("n_rows") >= MIN_STRATUM_ROWS)
    # where every actual sits on a key number the residuals are used as they are
    profile = profile.withColumn("plain", F.col("n_plain") > 0).withColumn(
        "mass", F.when(F.col("plain"), F.col("mass")).otherwise(F.transform("mass", lambda m: F.lit(0.0)))
    ).withColumn("n_points", F.when(F.col("plain"), F.col("n_plain")).otherwise(F.col("n_rows"))).drop("n_plain", "plain")
    points = located.groupBy(*sets, "stratum", "value").agg(
        F.count_if(~on_key).alias("_plain"), F.count(F.lit(1)).alias("_all")
    ).join(profile.select(*sets, "stratum", "n_rows", "n_points"), [*sets, "stratum"]).select(
        *sets, "stratum", "value",
        F.when(F.col("n_points") < F.col("n_rows"), F.col("_plain")).otherwise(F.col("_all")).alias("cnt"),
    ).filter("cnt > 0")
    return ResidualModel(sets, points, profile, edges, key_numbers)


def score_distribution(
    model: ResidualModel,
    queries: DataFrame,
    row_id: list[str],
    projection: str = "final",
    line: str = "line",
    stratum: str = "line",
    shrinkage: float = SHRINKAGE,
    keyed: Column | None = None,
) -> DataFrame:
    """Adds p_win, p_push and p_loss to ``queries``.

    The stratum's distribution is shrunk to the global one by n / (n + 200);
    a stratum below the minimum uses the global one alone. Every query row
    stays: a set with too few rows for a distribution gives null probabilities.
    """
    keyed = keyed if keyed is not None else F.col("market") == "spreads"
    sets = model.sets
    ids = list(dict.fromkeys([*sets, *row_id]))
    keys = [*sets, "stratum"]
    placed = queries.join(model.edges, sets).select(
        *ids, F.col(line).alias("_line"), (F.col(line) - F.col(projection)).alias("_t"), _stratum(_strata_value(F.col(stratum), keyed)).alias("_st"),
    )
    # rows are merged to what is asked for: a line and a threshold of a stratum; only these are scanned
    asked = placed.select(*sets, "_st", "_line", "_t").distinct().withColumn("stratum", F.explode(F.array(F.lit(GLOBAL), F.col("_st"))))
    asked = checkpointed(asked.select(*keys, "_line", "_t").distinct())
    tol = F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("_line"))
    kinds = F.array(
        F.struct(F.lit("at").alias("kind"), F.col("_t").alias("value")),
        F.struct(F.lit("lo").alias("kind"), (F.col("_t") - tol).alias("value")),
        F.struct(F.lit("hi").alias("kind"), (F.col("_t") + tol).alias("value")),
    )
    probes = asked.select(*keys, "_line", "_t", F.inline(kinds))
    counted = probes.join(counts_up_to(model.points, probes, keys), [*keys, "value"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = counted.groupBy(*keys, "_line", "_t").agg(
        pick("at", "below").alias("_lt"), pick("at", "at_most").alias("_le"), pick("lo", "below").alias("_lo"), pick("hi", "at_most").alias("_hi")
    )
    known = wide.join(model.profile, keys)
    plain = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate("mass", F.lit(0.0), lambda a, m: a + m))
    signed = F.array(*[F.lit(float(k)) for k in signed_keys(model.keys)])
    zipped = F.arrays_zip(signed.alias("k"), F.col("mass").alias("m"))

    def key_mass(test) -> Column:
        return F.aggregate(zipped, F.lit(0.0), lambda a, z: a + F.when(test(z["k"]), z["m"]).otherwise(0.0))

    n = F.col("n_points")
    raw = known.select(
        *keys, "_line", "_t", "n_rows",
        (plain * (n - F.col("_le")) / n + key_mass(lambda k: k > F.col("_line"))).alias("w"),
        (plain * (F.col("_hi") - F.col("_lo")) / n + key_mass(lambda k: k == F.col("_line"))).alias("p"),
        (plain * F.col("_lt") / n + key_mass(lambda k: k < F.col("_line"))).alias("l"),
    )
    total = F.col("w") + F.col("p") + F.col("l")
    unit = checkpointed(raw.withColumns({c: F.col(c) / total for c in ("w", "p", "l")}))
    share = F.col("n_rows") / (F.col("n_rows") + F.lit(float(shrinkage)))
    overall = unit.filter(F.col("stratum") == GLOBAL).select(*sets, "_line", "_t", *[F.col(c).alias(f"_g{c}") for c in ("w", "p", "l")])
    local = unit.filter(F.col("stratum") >= 0).select(
        *sets, F.col("stratum").alias("_st"), "_line", "_t", share.alias("_share"), *[F.col(c).alias(f"_s{c}") for c in ("w", "p", "l")]
    )
    sides = placed.join(overall, [*sets, "_line", "_t"], "left").join(local, [*sets, "_st", "_line", "_t"], "left")
    mixed = sides.select(
        *ids,
        *[
            F.coalesce(F.col("_share") * F.col(f"_s{c}") + (1 - F.col("_share")) * F.col(f"_g{c}"), F.col(f"_g{c}")).alias(name)
            for c, name in (("w", "p_win"), ("p", "p_push"), ("l", "p_loss"))
        ],
    )
    return queries.join(mixed, ids, "left")


class HeldResiduals:
    """:func:`fit_distribution` and :func:`score_distribution` of one set whose rows a task holds, as arrays without missing values.

    Edges, strata and key masses depend on actuals and lines alone: they are taken once, and
    any number of projections of the same rows are asked. Terms are added as the scan adds them.
    """

    def __init__(
        self, actual: np.ndarray, line: np.ndarray, asked: np.ndarray, keyed: bool,
        key_numbers: tuple[int, ...] = KEY_NUMBERS, shrinkage: float = SHRINKAGE,
    ):
        held, wanted = (np.abs(line), np.abs(asked)) if keyed else (line, asked)
        edges, ordered = [], np.sort(held)
        for p in (1.0 / 3.0, 2.0 / 3.0):
            at = (len(held) - 1) * p
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            edges.append(low + (high - low) * (at - np.floor(at)))
        stratum, self.asked = ((v > edges[0]).astype(int) + (v > edges[1]) for v in (held, wanted))
        signed = [float(k) for k in signed_keys(key_numbers)]
        on_key = np.isin(actual, signed) & keyed
        self.tolerance = 1e-8 + 1e-5 * np.abs(asked)
        self.shrinkage, self.parts = shrinkage, {}
        for s in (GLOBAL, *range(len(edges) + 1)):
            own = np.full(len(held), True) if s == GLOBAL else stratum == s
            n = int(own.sum())
            if n < MIN_STRATUM_ROWS:
                continue
            points = np.flatnonzero(own & ~on_key)
            mass = [float((np.abs(actual[own] - k) <= 1e-8 + 1e-5 * abs(k)).sum()) / n if keyed and len(points) else 0.0 for k in signed]
            who = np.arange(len(asked)) if s == GLOBAL else np.flatnonzero(self.asked == s)
            above, equal, below = (sum((np.where(test(k, asked[who]), m, 0.0) for k, m in zip(signed, mass, strict=True)), np.zeros(len(who)))
                                   for test in (np.greater, np.equal, np.less))
            plain = max(0.0, 1.0 - sum(mass, 0.0))
            self.parts[s] = (points if len(points) else np.flatnonzero(own), who, n, plain, above, equal, below)

    def probabilities(self, residuals: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(win, push, loss) of the asked rows; not a number where there are too few residuals."""
        out = np.full((3, len(thresholds)), np.nan)
        for s, (points, who, rows, plain, above, equal, below) in self.parts.items():  # the global one comes first
            value, t, tol = np.sort(residuals[points]), thresholds[who], self.tolerance[who]
            n, over = len(value), len(value) - np.searchsorted(value, t, "right")
            near = np.searchsorted(value, t + tol, "right") - np.searchsorted(value, t - tol, "left")
            win, push, loss = plain * over / n + above, plain * near / n + equal, plain * np.searchsorted(value, t, "left") / n + below
            mixed = np.stack([win, push, loss]) / (win + push + loss)
            share = rows / (rows + self.shrinkage)
            out[:, who] = mixed if s == GLOBAL else share * mixed + (1 - share) * out[:, who]
        return tuple(out)


def non_push(win: str | Column = "p_win", loss: str | Column = "p_loss") -> Column:
    w = F.col(win) if isinstance(win, str) else win
    lo = F.col(loss) if isinstance(loss, str) else loss
    return F.try_divide(w, w + lo)


def closing_anchored(
    model: ResidualModel,
    contracts: DataFrame,
    row_id: list[str],
    closing_line: str = "closing_line",
    closing_probability: str = "closing_probability",
    decision_line: str = "decision_line",
    keyed: Column | None = None,
) -> DataFrame:
    """Distribution at the decision line, anchored so that the closing line prices fairly.

    The logit gap between the closing fair probability and the empirical one
    at the closing line is carried over to the decision line; the push mass at
    the decision line is kept.
    """
    two = contracts.select(
        "*", F.inline(F.array(
            F.struct(F.lit("close").alias("_at"), F.col(closing_line).alias("_line")),
            F.struct(F.lit("decision").alias("_at"), F.col(decision_line).alias("_line")),
        )),
    )
    scored = score_distribution(model, two, [*row_id, "_at"], closing_line, "_line", closing_line, keyed=keyed)
    ids = list(dict.fromkeys([*model.sets, *row_id]))
    sides = scored.groupBy(*ids).agg(
        F.max(F.when(F.col("_at") == "close", non_push())).alias("_close"),
        F.max(F.when(F.col("_at") == "decision", non_push())).alias("_dec"),
        F.max(F.when(F.col("_at") == "decision", F.col("p_push"))).alias("closing_push"),
        F.max(closing_probability).alias("_fair"),
    )
    p = logistic(logit("_dec") + logit("_fair") - logit("_close"))
    anchored = sides.select(
        *ids,
        ((1 - F.col("closing_push")) * p).alias("closing_win"),
        "closing_push",
        ((1 - F.col("closing_push")) * (1 - p)).alias("closing_loss"),
    )
    return contracts.join(anchored, ids, "left")
