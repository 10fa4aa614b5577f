"""Bootstrap intervals from map-side replicate sums.

Row i of replicate r gets a Poisson weight by a counter-based generator: 64 bits of
the MD5 of (seed, row id), mixed with the number of the replicate, give a 16-bit
word that is looked up in a fixed Poisson table. Any engine with MD5 and 64-bit
arithmetic draws the same weights, and a repeated task does. Without a row id, rows
that agree in some columns (to nine decimals) are merged first and n of them draw one
Poisson(n) weight, which has the distribution of n weights drawn apart. A block is
drawn m times by the hash of (seed, block) in the task that holds its row, and its
rows then draw Poisson(m) weights; blocks are neither collected nor limited. Only
weighted sums per replicate leave a task; the shuffle carries replicates x
statistics numbers, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.fixed_values import BOOTSTRAP_SAMPLES, BOOTSTRAP_SEED

_CHUNK = 512
# constants of the generator: replicate step, the mixer's multipliers, step of the powers of two
STEP, MIX_1, MIX_2, POWER_STEP = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03


def _hash_words(ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Four 16-bit words per (row, group of four replicates)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] ^ (groups.astype(np.uint64)[None, :] * np.uint64(STEP))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
        x ^= x >> np.uint64(31)
    return x.view(np.uint16)


def poisson_table(mean: float) -> np.ndarray:
    """Poisson quantiles at the 65,536 midpoints of a 16-bit word; by the normal limit for large means."""
    at = (np.arange(65536) + 0.5) / 65536
    if mean > 1024:
        normal = NormalDist(mean, mean**0.5)
        return np.rint([normal.inv_cdf(q) for q in at])
    log_terms = np.arange(int(mean + 12 * mean**0.5 + 30))
    log_terms = log_terms * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(log_terms[1:]))])
    return np.searchsorted(np.cumsum(np.exp(log_terms)), at, side="right").astype(float)


class _Draws:
    """Poisson draws of any whole mean, as sums over the powers of two in it."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def __call__(self, ids: np.ndarray, groups: np.ndarray, means: np.ndarray) -> np.ndarray:
        """means: one per (id, replicate); draws of the same shape."""
        samples = means.shape[1]
        out = np.zeros(means.shape)
        for k in range(int(means.max(initial=0)).bit_length()):
            some = (means >> k) & 1 == 1
            if not some.any():
                continue
            if k not in self.tables:
                self.tables[k] = poisson_table(float(1 << k))
            with np.errstate(over="ignore"):
                words = _hash_words(ids.astype(np.uint64) + np.uint64(k) * np.uint64(POWER_STEP), groups)[:, :samples]
            out[some] += self.tables[k][words[some]]
        return out


def draw_id(seed: int, *parts: Column) -> Column:
    """The first 16 hex digits of the MD5 of seed and parts; null parts count as the word null."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), 1, 16)


def replicate_sums(
    df: DataFrame,
    row_id: str | None,
    values: dict[str, str],
    block: str | None = None,
    samples: int = BOOTSTRAP_SAMPLES,
    seed: int = BOOTSTRAP_SEED,
    identity: tuple[str, ...] = (),
) -> DataFrame:
    """Per replicate: Σ weight and Σ weight·value for every named SQL expression.

    ``row_id`` names a unique column, or is None to merge rows that agree in
    ``identity`` (the values, where it is empty).
    """
    names = list(values)
    reps = np.arange(samples)
    groups = np.arange(-(-samples // 4))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((samples, len(names) + 1))
        draw = _Draws()
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(dtype=float)])
            ids, blocks = (np.array([int(h, 16) for h in pdf[c]], np.uint64) for c in ("_h", "_b"))
            n = pdf["_n"].to_numpy(dtype=np.int64)
            for start in range(0, len(pdf), _CHUNK):
                part = slice(start, start + _CHUNK)
                means = np.broadcast_to(n[part][:, None], (len(ids[part]), samples))
                if block is not None:
                    means = means * draw(blocks[part], groups, np.ones_like(means)).astype(np.int64)
                total += draw(ids[part], groups, means).T @ x[part]
        out = pd.DataFrame(total, columns=["weight", *names])
        out.insert(0, "replicate", reps)
        yield out

    schema = ", ".join(["replicate int", "weight double", *[f"{n} double" for n in names]])
    exprs = [F.expr(e).cast("double").alias(n) for n, e in values.items()]
    where = (draw_id(seed, F.lit("block"), F.col(block)) if block else F.lit("0")).alias("_b")
    if row_id is None:
        same = [F.round(F.expr(e).cast("double") * 1e9).cast("bigint").alias(f"_i{i}") for i, e in enumerate(identity or values.values())]
        marks = [f"_i{i}" for i in range(len(same))]
        prepared = df.select(where, *same, *exprs).groupBy("_b", *marks).agg(F.count(F.lit(1)).alias("_n"), *[F.min(n).alias(n) for n in names])
        prepared = prepared.withColumn("_h", draw_id(seed, F.col("_b"), *[F.col(m) for m in marks]))
    else:
        prepared = df.select(where, *exprs, F.lit(1).cast("bigint").alias("_n"), draw_id(seed, F.lit("row"), F.col(row_id)).alias("_h"))
    partial = prepared.mapInPandas(fold, schema)
    return partial.groupBy("replicate").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(n) for n in names])


def interval(replicates: DataFrame, statistics: dict[str, str]) -> DataFrame:
    """95 % interval and median of each statistic (a SQL expression over the sums)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.expr(e).alias("value")) for n, e in statistics.items()])
    rows = replicates.filter("weight > 0").select(F.inline(pairs))
    q = rows.groupBy("metric").agg(F.percentile("value", F.array(*[F.lit(x) for x in (0.025, 0.5, 0.975)])).alias("q"))
    return q.select(
        "metric", F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper_95")
    )


def rmse_difference(df: DataFrame, row_id: str | None, actual: str, final: str, line: str, season: str, samples: int = BOOTSTRAP_SAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Season-block bootstrap of RMSE(final) - RMSE(line)."""
    sums = replicate_sums(
        df, row_id, {"ef": f"pow({actual} - {final}, 2)", "el": f"pow({actual} - {line}, 2)"}, season, samples, seed, (actual, final, line)
    )
    return interval(sums, {"final_minus_market_rmse": "sqrt(ef / weight) - sqrt(el / weight)"})


def paired_scores(df: DataFrame, row_id: str | None, outcome: str, model: str, market: str, samples: int = BOOTSTRAP_SAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Paired bootstrap of the Brier and log-loss differences."""

    def clipped(p: str) -> str:
        return f"greatest(1e-8, least(1 - 1e-8, {p}))"

    def loss(p: str) -> str:
        return f"-({outcome} * ln({clipped(p)}) + (1 - {outcome}) * ln(1 - {clipped(p)}))"

    sums = replicate_sums(
        df, row_id,
        {
            "brier": f"pow({clipped(model)} - {outcome}, 2) - pow({clipped(market)} - {outcome}, 2)",
            "log_loss": f"{loss(model)} - ({loss(market)})",
        },
        None, samples, seed, (outcome, model, market),
    )
    return interval(sums, {"brier": "brier / weight", "log_loss": "log_loss / weight"})
