"""Ordered scans that never place one key, or the whole table, in one task.

A window without ``partitionBy`` runs in a single task, and a window over a hot
key in a single task too. Here rows are range-partitioned on (key, order), so a
hot key spreads over many partitions; each range is scanned by itself and a
small table of per-range totals supplies what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.session import checkpointed

RANGE = "_range"


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition and record the range of each row.

    The rows are written out once, so a lost executor cannot lead to other
    range bounds in one of the two reads that follow. No partition count is
    given: adjacent small ranges may be merged at run time, in order.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return checkpointed(ranged.withColumn(RANGE, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, Column],
    keys: list[str] | None = None,
) -> DataFrame:
    """Exact inclusive running sums of ``totals`` in ``order`` within ``keys``.

    ``order`` must be a total order: it ends in a unique column.
    """
    keys = keys or []
    named = {name: f"_value_{i}" for i, name in enumerate(totals)}
    rows = _ranged(df.withColumns({named[n]: e for n, e in totals.items()}), keys, order)
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumns({n: F.sum(v).over(inside) for n, v in named.items()})
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(RANGE, *keys).agg(*[F.sum(v).alias(v) for v in named.values()])
    offsets = sums.select(
        RANGE, *keys, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in named.values()]
    )
    joined = scanned.join(offsets, [RANGE, *keys])
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.col(f"{v}_before")).alias(n) for n, v in named.items()],
    )


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number", keys: list[str] | None = None) -> DataFrame:
    """Exact row numbers of the whole table (or of each, possibly hot, key)."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, keys)


def equal_count_bins(df: DataFrame, order: list[Column], bins: int, name: str = "bin") -> DataFrame:
    """``ntile`` over the whole table: the first n mod k bins hold one row more."""
    numbered = row_numbers(df, order, "_rn")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    base, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    cut = extra * (base + 1)
    big = F.floor((F.col("_rn") - 1) / (base + 1))
    small = extra + F.floor(F.try_divide(F.col("_rn") - 1 - cut, base))
    return (
        numbered.withColumn("_n", total)
        .withColumn(name, (F.when(F.col("_rn") <= cut, big).otherwise(small) + 1).cast("int"))
        .drop("_rn", "_n")
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], keys: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key, one column ``q<i>`` each.

    Equal values are counted before the shuffle, so ties cannot make a hot
    partition; the ranks come from a running count over the distinct values.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = running_totals(counts, [F.col(value)], {"_upto": F.col("_cnt")}, keys)
    size = counts.groupBy(*keys).agg(F.sum("_cnt").alias("_n"))
    if keys:
        spread = ranked.join(size, keys)
    else:
        spread = ranked.withColumn("_n", size.scalar())
    first = F.col("_upto") - F.col("_cnt")  # ranks first .. upto-1, zero based

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col(value)))

    aggs = []
    for i, p in enumerate(probabilities):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    out = spread.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(probabilities))
        ],
    )


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    carried: str,
    name: str,
) -> DataFrame:
    """Last non-null ``carried`` value up to and including each row, per key.

    A hot key is split by its order over many ranges; each range hands its
    last value to the ranges after it.
    """
    rows = _ranged(df, keys, order)
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("_local", F.last(carried, ignorenulls=True).over(inside))
    seen = F.when(F.col(carried).isNotNull(), F.struct(*order))
    tails = rows.groupBy(RANGE, *keys).agg(F.max_by(carried, seen).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    handed = tails.select(RANGE, *keys, F.last("_tail", ignorenulls=True).over(before).alias("_handed"))
    joined = scanned.join(handed, [RANGE, *keys])
    return joined.select(*df.columns, F.coalesce("_local", "_handed").alias(name))


def lags(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    columns: list[str],
    n: int = 1,
    name=lambda k, c: f"lag{k}_{c}",
) -> DataFrame:
    """Lags 1..n of ``columns`` per key, with a hot key split over its order.

    Each range lags its own rows; the last n rows of the ranges before it (at
    least one row each, so n ranges are enough) supply its first rows.
    """
    rows = _ranged(df, keys, order)
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order)
    backward = Window.partitionBy(RANGE, *keys).orderBy(*[o.desc() for o in order])
    numbered = rows.withColumns(
        {"_rn": F.row_number().over(inside), **{f"_in{k}_{c}": F.lag(c, k).over(inside) for k in range(1, n + 1) for c in columns}}
    )
    last = rows.withColumn("_back", F.row_number().over(backward)).filter(F.col("_back") <= n)
    tail = last.groupBy(RANGE, *keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *columns))).alias("_tail")
    )
    near = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(-n, -1)
    handed = tail.select(RANGE, *keys, F.flatten(F.collect_list("_tail").over(near)).alias("_handed"))
    joined = numbered.join(handed, [RANGE, *keys])

    def lagged(k: int, c: str) -> Column:
        # counted from the end of what came before this range
        from_end = F.col("_rn") - k - 1
        return F.when(F.col("_rn") > k, F.col(f"_in{k}_{c}")).otherwise(F.try_element_at("_handed", from_end.cast("int"))[c])

    return joined.select(*df.columns, *[lagged(k, c).alias(name(k, c)) for k in range(1, n + 1) for c in columns])
