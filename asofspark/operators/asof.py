"""Time-aware and checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.operators.scan import carry_forward, running_totals


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """Equi-join that fails, when it runs, if a side declared unique is not.

    The count of the unique side rides along the join, so no extra job is
    started and the plan stays lazy.
    """
    def guarded(df: DataFrame, label: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        one = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r") if rest else F.lit(1).alias("_r"))
        message = F.concat(F.lit(f"{label} side is not unique on {on}: "), F.to_json(F.struct(*on)))
        key0 = F.when(F.col("_n") > 1, F.raise_error(message).cast(df.schema[on[0]].dataType)).otherwise(F.col(on[0]))
        cols = [key0.alias(on[0]), *on[1:]] + ([F.col(f"_r.{c}").alias(c) for c in rest] if rest else [])
        return one.select(*cols)

    l_unique, r_unique = validate.split(":")
    if r_unique == "1":
        right = guarded(right, "right")
    if l_unique == "1":
        left = guarded(left, "left")
    return left.join(right, on, how)


def mapped_lookup(df: DataFrame, key: str, mapping: dict[str, str], out: str, strict: bool = True) -> DataFrame:
    """Display name to id through a literal map; an unmapped name is an error."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.try_element_at(F.create_map(*pairs), F.col(key))
    if strict:
        missing = F.raise_error(F.concat(F.lit(f"unmapped {key}: "), F.coalesce(F.col(key), F.lit("null"))))
        value = F.coalesce(value, missing.cast("string"))
    return df.withColumn(out, value)


def crosswalk(players: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Id pairs with both ids known; each id marked by how often it occurs."""
    pairs = players.select(left_id, right_id).dropna()
    dup_l = unique_key_violations(pairs, [left_id]).select(left_id)
    dup_r = unique_key_violations(pairs, [right_id]).select(right_id)
    return pairs.join(dup_l, left_id, "left_anti").join(dup_r, right_id, "left_anti")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    payload: list[str],
    left_id: str,
    inclusive: bool = True,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """Latest right row at or before (or strictly before) each left row.

    Both inputs are stacked and scanned in time order over ranges of
    (key, time), so a key with a third of all rows is still split.
    """
    ties = tie_break or []
    carried = F.struct(F.col(right_ts).alias("_t"), *payload)
    r = right.select(
        *on,
        F.col(right_ts).alias("_time"),
        F.lit(1 if not inclusive else 0).alias("_side"),
        F.struct(*ties).alias("_tie") if ties else F.lit(0).alias("_tie"),
        carried.alias("_value"),
        F.lit(None).cast("boolean").alias("_keep"),
    )
    keep_cols = F.struct(*[c for c in left.columns])
    l = left.select(
        *on,
        F.col(left_ts).alias("_time"),
        F.lit(1 if inclusive else 0).alias("_side"),
        F.lit(None).alias("_tie"),
        F.lit(None).alias("_value"),
        F.lit(True).alias("_keep"),
        keep_cols.alias("_left"),
        F.col(left_id).alias("_id"),
    )
    stacked = l.unionByName(r, allowMissingColumns=True)
    order = [F.col("_time"), F.col("_side"), F.col("_tie"), F.col("_id")]
    scanned = carry_forward(stacked, on, order, "_value", "_asof").filter(F.col("_keep"))
    return scanned.select(
        "_left.*", F.col("_asof._t").alias(right_ts if right_ts not in left.columns else f"right_{right_ts}"),
        *[F.col(f"_asof.{p}").alias(p) for p in payload],
    )


def latest_before(df: DataFrame, keys: list[str], ts: str, cutoff: Column, payload: list[str]) -> DataFrame:
    """Latest row per key strictly before one cutoff, folded map-side."""
    picked = df.filter(F.col(ts) < cutoff).groupBy(*keys).agg(F.max_by(F.struct(ts, *payload), F.struct(ts, *payload)).alias("_r"))
    return picked.select(*keys, "_r.*")


def _only_within(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_ts: str, right_id: str, right_ts: str, micros: int) -> DataFrame:
    """Left rows with exactly one right row within the tolerance, and that row.

    Right rows are numbered in time order; a left row's window holds the
    numbers between two running counts, so its single match is found by
    number. No pairs are formed, however many rows share a key.
    """
    def at(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    points = right.select(*on, at(right_ts).alias("_v"), F.lit(1).alias("_tag"), F.lit(1).cast("bigint").alias("_cnt"), F.col(right_id).alias("_rid"))
    edges = F.inline(F.array(
        F.struct((at(left_ts) - micros).alias("_v"), F.lit(0).alias("_tag")), F.struct((at(left_ts) + micros).alias("_v"), F.lit(2).alias("_tag"))
    ))
    probes = left.select(*on, F.col(left_id).alias("_lid"), edges).withColumn("_cnt", F.lit(0).cast("bigint"))
    ranked = running_totals(points.unionByName(probes, allowMissingColumns=True), [F.col("_v"), F.col("_tag")], {"_n": F.col("_cnt")}, on)
    windows = ranked.filter(F.col("_tag") != 1).groupBy(*on, "_lid").agg(
        F.max(F.when(F.col("_tag") == 2, F.col("_n"))).alias("_n"), F.max(F.when(F.col("_tag") == 0, F.col("_n"))).alias("_before")
    )
    single = windows.filter(F.col("_n") - F.col("_before") == 1)
    numbered = ranked.filter(F.col("_tag") == 1).select(*on, "_n", "_rid")
    return single.join(numbered, [*on, "_n"]).select(F.col("_lid").alias(left_id), F.col("_rid").alias(right_id))


def interval_match(
    events: DataFrame,
    schedule: DataFrame,
    on: list[str],
    event_ts: str,
    schedule_ts: str,
    event_id: str,
    schedule_id: str,
    tolerance_seconds: int,
) -> DataFrame:
    """Pairs within an inclusive time tolerance that are one-to-one in both directions."""
    micros = tolerance_seconds * 1_000_000
    forward = _only_within(events, schedule, on, event_id, event_ts, schedule_id, schedule_ts, micros)
    backward = _only_within(schedule, events, on, schedule_id, schedule_ts, event_id, event_ts, micros)
    return forward.join(backward, [event_id, schedule_id], "left_semi").select(event_id, schedule_id)
