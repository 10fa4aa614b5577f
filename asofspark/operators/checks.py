"""Data-quality checks with one result shape.

Every check yields rows (check_id, table, violations). The checks of a table
share one aggregate wherever they can, so a table is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.functions.scalars import col, content_hash, minutes_between
from asofspark.operators.asof import asof_join
from asofspark.operators.temporal import lag_name

OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


# --- schema, at plan time ------------------------------------------------------


def schema_differences(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences in order, name or type; empty when equal."""
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    out = [f"missing {n} {t}" for n, t in want if (n, t) not in got]
    out += [f"unexpected {n} {t}" for n, t in got if (n, t) not in want]
    if not out and got != want:
        out.append("columns are in another order")
    return out


def assert_schema(df: DataFrame, expected: T.StructType, name: str = "table") -> DataFrame:
    problems = schema_differences(df, expected)
    if problems:
        raise ValueError(f"{name} schema mismatch: {'; '.join(problems)}")
    return df


def require_columns(df: DataFrame, columns: list[str] | set[str], name: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


# --- row checks ------------------------------------------------------------------


def check_bundle(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """Violation counts of many row predicates in one pass."""
    counts = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(n).alias("violations")) for n in checks])
    return counts.select(F.inline(rows)).select("check_id", F.lit(table).alias("table"), "violations")


def _counted(df: DataFrame, check_id: str, table: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(check_id).alias("check_id"), F.lit(table).alias("table"), "violations"
    )


def duplicate_keys(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _counted(dup, "duplicate_keys", table)


def missing_metadata(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    return check_bundle(df, table, {f"null_{c}": F.col(c).isNull() for c in columns})


def castable(df: DataFrame, table: str, numeric: dict[str, str], timestamps: list[str]) -> DataFrame:
    """Text that does not cast strictly; timestamps need an explicit offset."""
    checks = {f"not_{t}_{c}": F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in numeric.items()}
    checks |= {
        f"naive_{c}": F.col(c).isNotNull() & (~F.col(c).rlike(OFFSET) | F.try_to_timestamp(F.col(c)).isNull())
        for c in timestamps
    }
    return check_bundle(df, table, checks)


def hash_mismatch(df: DataFrame, table: str, stored: str = "content_hash", exclude: tuple[str, ...] = ("content_hash", "retrieved_at_utc")) -> DataFrame:
    return check_bundle(df, table, {"content_hash_mismatch": ~F.col(stored).eqNullSafe(content_hash(df, exclude))})


def lag_boundaries(lags: DataFrame, table: str = "lags", ts: str = "kickoff_dt", n: int = 4) -> DataFrame:
    """No lagged time may reach its own row's time."""
    return check_bundle(lags, table, {f"lag{k}_not_before": F.col(lag_name(k, ts)) >= F.col(ts) for k in range(1, n + 1)})


def latest_completed(lags: DataFrame, history: DataFrame, table: str = "lags", entity: str = "team_id", season: str = "season", ts: str = "kickoff_dt", row_id: str = "game_id") -> DataFrame:
    """Lag 1 of each row is the true latest completed event of the entity season.

    ``history`` has one row per (entity, season, completed event).
    """
    done = history.select(entity, season, F.col(ts).alias("_t"), F.lit(True).alias("_done"))
    who = F.concat_ws("|", F.col(entity).cast("string"), F.col(row_id).cast("string"))
    looked = asof_join(
        lags.select(entity, season, ts, lag_name(1, ts), who.alias("_rid")), done, [entity, season], ts, "_t", ["_done"], "_rid", False
    )
    return check_bundle(looked, table, {"latest_completed_mismatch": ~F.col(lag_name(1, ts)).eqNullSafe(F.col("_t"))})


def orphans(child: DataFrame, parent: DataFrame, table: str, on: list[str]) -> DataFrame:
    return _counted(child.join(parent.select(*on), on, "left_anti"), "orphan_" + "_".join(on), table)


def unmatched_counts(tables: dict[str, DataFrame], parent: DataFrame, on: str) -> DataFrame:
    parts = [orphans(df, parent, name, [on]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def group_size(df: DataFrame, table: str, keys: list[str], size: int = 2) -> DataFrame:
    wrong = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != size)
    return _counted(wrong, f"group_size_not_{size}", table)


def dimension_equality(df: DataFrame, dim: DataFrame, table: str, on: list[str], column: str) -> DataFrame:
    joined = df.join(dim.select(*on, F.col(column).alias("_dim")), on)
    return check_bundle(joined, table, {f"{column}_differs": ~F.col(column).eqNullSafe(F.col("_dim"))})


def sums_to_one(*parts: str | Column, tolerance: float = 1e-9) -> Column:
    """Violation predicate of a probability triple."""
    total = reduce(lambda a, b: a + b, [col(p) for p in parts])
    return F.abs(total - 1.0) > tolerance


def out_of_order(*times: str) -> Column:
    """Violation predicate: some time is later than the one after it."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in zip(times, times[1:])])


def window_violation(start: str, at: str, latest: float, earliest: float) -> Column:
    return ~F.coalesce(minutes_between(start, at).between(latest, earliest), F.lit(False))


def conditional_nulls(condition: Column, required: list[str] = (), forbidden: list[str] = ()) -> Column:
    """Violation predicate: rows meeting the condition lack a required value or carry a forbidden one."""
    bad = [F.col(c).isNull() for c in required] + [F.col(c).isNotNull() for c in forbidden]
    return condition & reduce(lambda a, b: a | b, bad)


def not_in_domain(column: str, allowed: tuple) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def bad_probability(column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) | ~((c > 0.0) & (c < 1.0))


def reconcile_counts(a: DataFrame, b: DataFrame, table: str) -> DataFrame:
    """Absolute difference of two row counts."""
    n = b.agg(F.count(F.lit(1)).alias("n"))
    return a.agg(F.count(F.lit(1)).alias("m")).select(
        F.lit("row_count_difference").alias("check_id"), F.lit(table).alias("table"),
        F.abs(F.col("m") - n.scalar()).alias("violations"),
    )


def declared_counts(parent: DataFrame, child: DataFrame, table: str, key: str, declared: str) -> DataFrame:
    """Parents whose declared child count differs from the children found."""
    found = child.groupBy(key).agg(F.count(F.lit(1)).alias("_found"))
    joined = parent.join(found, key, "left")
    return check_bundle(joined, table, {f"{declared}_mismatch": F.col(declared) != F.coalesce("_found", F.lit(0))})


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blocking_reasons(checks: DataFrame) -> DataFrame:
    """Readiness audit: READY, or the sorted list of failing checks.

    The checks are few; their rows are the only ones gathered.
    """
    failing = F.when(F.col("violations") > 0, F.concat_ws(":", "table", "check_id"))
    return checks.agg(
        F.array_sort(F.collect_list(failing)).alias("blocking_reasons"),
        F.when(F.sum("violations") > 0, F.lit("DATA QUALITY FAILURE")).otherwise(F.lit("READY")).alias("status"),
    )


# --- profiles ------------------------------------------------------------------


def profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, nulls, type and exact distinct-free statistics per column."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(c).alias("missing"))
            for c, t in df.dtypes
        ]
    )
    return counts.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.inline(rows))


def moments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean, population sd, min and max per column, in long form."""
    keys = keys or []
    aggs = [
        F.struct(
            F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
        )
        for c in columns
    ]
    return df.groupBy(*keys).agg(F.array(*aggs).alias("_p")).select(*keys, F.inline("_p"))


def latest_time(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest timestamp over several tables."""
    parts = [df.agg(F.max(c).cast("timestamp_ntz").alias("latest")) for df, c in tables.values()]
    return reduce(DataFrame.union, parts).agg(F.max("latest").alias("latest"))


def exclusion_rates(df: DataFrame, reasons: Column, season: str = "season", limit: float = 0.05) -> DataFrame:
    """Share of rows with any exclusion reason per season, and the breach flag."""
    hit = F.length(reasons) > 0
    rate = F.avg(hit.cast("double"))
    return df.groupBy(season).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("excluded"), rate.alias("rate"), (rate > limit).alias("breach")
    )


def mapped_counts(df: DataFrame, crosswalk: DataFrame, key: str, position: str, positions: tuple[str, ...]) -> DataFrame:
    """Mapped and unmapped rows per position, through a unique crosswalk."""
    known = crosswalk.select(key).distinct().withColumn("_mapped", F.lit(True))
    return (
        df.filter(F.col(position).isin(*positions))
        .join(known, key, "left")
        .groupBy(position)
        .agg(F.count_if(F.col("_mapped").isNotNull()).alias("mapped"), F.count_if(F.col("_mapped").isNull()).alias("unmapped"))
    )
