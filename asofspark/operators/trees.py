"""Histogram boosting of all folds together, and ensembles held as tables.

Features are binned once. One job then grows the trees of every (keys, fold) model in
step: its tasks keep their rows, and in every step exchange the sums of residuals
and the counts per (model, node, feature, bin) of the new leaves. All tasks see the same
sums and so choose the same splits: the leaf with the greatest gain first, ridge-shrunk
leaf values, at most ``max_leaves`` leaves. Jobs follow the rounds (``ROUNDS_A_JOB`` each),
not folds or markets: a lost executor repeats one job, which starts from the trees of the
jobs before.

The exchange is a barrier stage's gather, one message of models x features x bins
numbers a task and step, whatever the rows; tasks hold ``ROWS_A_TASK`` rows, and more only
where fewer tasks can run at once. Clusters with dynamic allocation refuse barrier stages.

A model is a row of small arrays (its trees' nodes). Rows are joined with the number of their
model and go through its trees in NumPy, batch by batch; :func:`ensemble` is an array fold in the JVM
and :func:`unrolled` plain conditions, for a few trees.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.session import checkpointed

BLENDS = {"ridge": 1.0, "tree": 0.0, "blend_25": 0.25, "blend_50": 0.50, "blend_75": 0.75}
ROWS_A_TASK = 50_000
ROUNDS_A_JOB = 100
ROWS_A_STEP = 500
"""Rows that a task takes through all trees at once."""
LEAST_GAIN = 1e-9

_NODE = "array<struct<feature:int,threshold:double,left:int,right:int,value:double>>"


@dataclass(frozen=True)
class Boosting:
    """Settings of the booster."""

    rounds: int = 200
    learning_rate: float = 0.05
    max_leaves: int = 15
    min_leaf: int = 20
    l2: float = 10.0
    max_bins: int = 128


@dataclass
class _Leaf:
    node: int
    hist: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1


@dataclass
class _Fit:
    """One model within a task: its training rows here, and the tree that grows."""

    rows: np.ndarray
    target: np.ndarray
    score: np.ndarray
    base: float = 0.0
    at: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    nodes: list = field(default_factory=list)
    leaves: list = field(default_factory=list)


def best_split(leaf: _Leaf, cfg: Boosting) -> _Leaf:
    """Fills in the split with the greatest gain; ties go to the first feature, then the lowest bin."""
    left = leaf.hist.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    g = left[..., 0] ** 2 / (left[..., 1] + cfg.l2) + right[..., 0] ** 2 / (right[..., 1] + cfg.l2)
    g = g - total[..., 0] ** 2 / (total[..., 1] + cfg.l2)
    g[(left[..., 1] < cfg.min_leaf) | (right[..., 1] < cfg.min_leaf)] = -np.inf
    leaf.feature, leaf.bin = (int(i) for i in np.unravel_index(np.argmax(g), g.shape))
    leaf.gain = float(g[leaf.feature, leaf.bin])
    return leaf


def histogram(codes: np.ndarray, rows: np.ndarray, residual: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of residuals and counts per (feature, bin)."""
    picked = codes[rows].ravel()
    size = shape[0] * shape[1]
    sums = np.bincount(picked, np.repeat(residual, shape[0]), size)
    return np.stack([sums, np.bincount(picked, minlength=size)], -1).reshape(*shape, 2)


def grow_round(fits: list[_Fit], codes: np.ndarray, shape: tuple[int, int], cfg: Boosting, total) -> None:
    """One tree for every model, leaf by leaf; ``total`` adds an array up over all tasks."""
    residuals = [f.target - f.score for f in fits]
    roots = total(np.stack([histogram(codes, f.rows, r, shape) for f, r in zip(fits, residuals, strict=True)]))
    for f, h in zip(fits, roots, strict=True):
        f.at = np.zeros(len(f.rows), np.int32)
        f.nodes = [[-1, 0.0, -1, -1, 0.0]]
        f.leaves = [best_split(_Leaf(0, h), cfg)]
    for _ in range(cfg.max_leaves - 1):
        picks = []
        for f, r in zip(fits, residuals, strict=True):
            leaf = max(f.leaves, key=lambda x: x.gain)  # the first of equals
            if leaf.gain <= LEAST_GAIN:
                continue
            n = len(f.nodes)
            f.nodes[leaf.node] = [leaf.feature, leaf.bin, n, n + 1, 0.0]
            f.nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
            f.leaves.remove(leaf)
            here = np.flatnonzero(f.at == leaf.node)
            goes_left = codes[f.rows[here], leaf.feature] - leaf.feature * shape[1] <= leaf.bin
            f.at[here] = np.where(goes_left, n, n + 1)
            counts = leaf.hist[leaf.feature, :, 1]
            small = n if 2 * counts[: leaf.bin + 1].sum() <= counts.sum() else n + 1
            rows = here[goes_left if small == n else ~goes_left]
            picks.append((f, leaf, small, histogram(codes, f.rows[rows], r[rows], shape)))
        if not picks:
            break
        for (f, leaf, small, _), h in zip(picks, total(np.stack([p[3] for p in picks])), strict=True):
            other = 2 * len(f.nodes) - 3 - small
            f.leaves += [best_split(_Leaf(i, x), cfg) for i, x in sorted([(small, h), (other, leaf.hist - h)], key=lambda p: p[0])]
    for f in fits:
        values = np.zeros(len(f.nodes))
        for leaf in f.leaves:
            g, n = leaf.hist[0].sum(axis=0)
            f.nodes[leaf.node][4] = values[leaf.node] = cfg.learning_rate * g / (n + cfg.l2)
        f.score = f.score + values[f.at]


def depth(nodes: list) -> int:
    """Splits on the longest way down; children come after their parent."""
    down = [0] * len(nodes)
    for i, n in enumerate(nodes):
        for c in n[2:4]:
            if c >= 0:
                down[c] = down[i] + 1
    return max(down)


def tree_values(nodes: list, x: np.ndarray) -> np.ndarray:
    """Values of one tree for rows of features."""
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        n = at[inner]
        at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])


def bin_edges(rows: DataFrame, features: list[str], max_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of every feature; one aggregate, and max_bins numbers a feature to the driver."""
    shares = [i / max_bins for i in range(1, max_bins)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(e or [0.0], float)) for e in got]


def boost_folds(
    rows: DataFrame, keys: list[str], features: list[str], folds: list[int], target: str = "target", season: str = "season",
    min_train: int = 100, settings: Boosting = Boosting(),
) -> DataFrame:
    """The model table: keys, season (the fold), base, n_train, depth and trees.

    The model of a fold learns from the seasons before it. Rows without a key,
    season or target, or with a null feature, are left out. Folds with fewer than
    ``min_train`` earlier rows have no model. Written.
    """
    spark = rows.sparkSession
    kept = rows.select(*keys, season, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    kept = checkpointed(kept.dropna())
    edges = bin_edges(kept, features, settings.max_bins)
    groups = [tuple(r) for r in kept.select(*keys).distinct().collect()]
    models = [(g, f) for g in sorted(groups) for f in sorted(folds)]
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-kept.count() // ROWS_A_TASK)))
    shape, columns = (len(features), settings.max_bins), kept.columns
    made = T.StructType.fromDDL(f"base double, n_train bigint, round int, depth int, nodes {_NODE}")
    schema = T.StructType([*(kept.schema[k] for k in [*keys, season]), *made.fields])

    def job(first: int, rounds: int, grown: dict):
        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = BarrierTaskContext.get()
            alone = len(context.getTaskInfos()) == 1

            def total(a: np.ndarray) -> np.ndarray:
                if alone:
                    return a
                told = context.allGather(base64.b64encode(np.ascontiguousarray(a, "<f8").tobytes()).decode())
                return sum(np.frombuffer(base64.b64decode(m), "<f8").reshape(a.shape) for m in told)

            parts = list(batches)
            data = pd.concat(parts) if parts else pd.DataFrame(columns=columns)
            data = data.sort_values(columns, ignore_index=True)  # sums then add up in one order
            x = data[features].to_numpy(float)
            codes = np.stack([np.searchsorted(e, x[:, i]) + i * shape[1] for i, e in enumerate(edges)], 1).astype(np.int32)
            y, when = data["_y"].to_numpy(float), data[season].to_numpy()
            fits = []
            for g, fold in models:
                own = np.flatnonzero(np.logical_and.reduce([when < fold, *(data[k].to_numpy() == v for k, v in zip(keys, g, strict=True))]))
                fits.append(_Fit(own, y[own], np.zeros(len(own))))
            sums = total(np.array([[f.target.sum(), len(f.rows)] for f in fits]).reshape(-1, 2))
            active = [(m, f, s, int(n)) for m, f, (s, n) in zip(models, fits, sums, strict=True) if n >= max(min_train, 1)]
            for m, f, s, n in active:
                f.base = s / n
                f.score = f.base + sum((tree_values(t, x[f.rows]) for t in grown.get(m, [])), np.zeros(len(f.rows)))
            out = []
            for r in range(first, first + rounds):
                if not active:
                    break
                grow_round([f for _, f, _, _ in active], codes, shape, settings, total)
                for (g, fold), f, _, n in active:
                    for node in f.nodes:
                        if node[0] >= 0:
                            e = edges[node[0]]
                            node[1] = float(e[min(node[1], len(e) - 1)])
                    out.append((*g, fold, f.base, n, r, depth(f.nodes), [dict(zip(("feature", "threshold", "left", "right", "value"), t, strict=True)) for t in f.nodes]))
            if context.partitionId() == 0 and out:
                yield pd.DataFrame(out, columns=schema.names)

        return fit

    spread, grown, parts = kept.repartition(tasks, *keys, season, *features, "_y"), {}, []
    for first in range(0, settings.rounds, ROUNDS_A_JOB):
        part = checkpointed(spread.mapInPandas(job(first, min(ROUNDS_A_JOB, settings.rounds - first), grown), schema, barrier=True))
        parts.append(part)
        if first + ROUNDS_A_JOB < settings.rounds:
            for r in part.orderBy("round").collect():
                grown.setdefault((tuple(r[k] for k in keys), r[season]), []).append([list(n) for n in r.nodes])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("round", "nodes")))
    rest = [F.min("base").alias("base"), F.min("n_train").alias("n_train"), F.max("depth").alias("depth")]
    return checkpointed(every.groupBy(*keys, season).agg(*rest, F.transform(ordered, lambda t: t.nodes).alias("trees")))


def leaf_value(tree: Column, x: Column, depth: Column) -> Column:
    """Value of a tree's leaf that the features ``x`` (an array) reach in ``depth`` steps; null features go left."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(tree, at)
        value = F.get(x, node.feature)
        return F.when(node.feature < 0, at).when(value.isNull() | (value <= node.threshold), node.left).otherwise(node.right)

    return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), depth)), F.lit(0), step)).value


def ensemble(base: str | Column, trees: str | Column, depth: str | Column, x: Column) -> Column:
    """Projection of a model row for the features ``x``: an array fold over its trees, in the JVM."""
    b = F.col(base) if isinstance(base, str) else base
    t = F.col(trees) if isinstance(trees, str) else trees
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.aggregate(t, b.cast("double"), lambda acc, tree: acc + leaf_value(tree, x, d))


def unrolled(base: float, trees: list, x: Column) -> Column:
    """Projection of a small ensemble, given as node lists, for the features ``x``: plain conditions, which Spark compiles; null features go left."""

    def value(nodes: list, at: int = 0) -> Column:
        feature, threshold, left, right, leaf = nodes[at]
        if feature < 0:
            return F.lit(float(leaf))
        v = F.get(x, F.lit(feature))
        return F.when(v.isNull() | (v <= F.lit(float(threshold))), value(nodes, left)).otherwise(value(nodes, right))

    total = F.lit(float(base))
    for nodes in trees:
        total = total + value(nodes)
    return total


def _packed(trees: list) -> tuple[np.ndarray, ...]:
    """Feature, threshold, left, right and value of every node, one row a tree; unused places are leaves."""
    made = [np.full((len(trees), max(map(len, trees), default=1)), x) for x in (-1, 0.0, -1, -1, 0.0)]
    for t, nodes in enumerate(trees):
        for into, column in zip(made, zip(*nodes, strict=True), strict=True):
            into[t, : len(column)] = column
    return tuple(made)


def packed_values(base: float, packed: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Projections of an ensemble for rows of features: all trees step down together, and are added up in order."""
    feature, threshold, left, right, value = packed
    tree, row = np.arange(len(feature))[None, :], np.arange(len(x))[:, None]
    at = np.zeros((len(x), len(feature)), np.int64)
    while True:
        f = feature[tree, at]
        inner = f >= 0
        if not inner.any():
            return np.add.accumulate(np.hstack([np.full((len(x), 1), base), value[tree, at]]), axis=1)[:, -1]
        goes_left = x[row, np.maximum(f, 0)] <= threshold[tree, at]
        at = np.where(inner, np.where(goes_left, left[tree, at], right[tree, at]), at)


def score_trees(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str], name: str = "tree_raw") -> DataFrame:
    """``rows`` with the projection of the model that shares their keys; rows without a model are left out.

    The model table is bounded by the grid. Its trees go to the tasks once; rows are
    joined with the number of their model only, so no row ever carries trees.
    """
    spark = rows.sparkSession
    models = model.select(*keys, "base", "trees").collect()
    held = spark.sparkContext.broadcast([(m.base, _packed(m.trees)) for m in models])
    schema = T.StructType([*(model.schema[k] for k in keys), T.StructField("_model", T.IntegerType())])
    numbers = spark.createDataFrame([(*(m[k] for k in keys), i) for i, m in enumerate(models)], schema)

    @F.pandas_udf("double")
    def score(number: pd.Series, *x: pd.Series) -> pd.Series:
        number, values, out = number.to_numpy(), np.column_stack([c.to_numpy(float) for c in x]), np.empty(len(number))
        for i in np.unique(number):
            own = np.flatnonzero(number == i)
            for part in np.split(own, range(ROWS_A_STEP, len(own), ROWS_A_STEP)):
                out[part] = packed_values(*held.value[i], values[part])
        return pd.Series(out)

    # a null goes left like the least number; other missing values are greater than any
    x = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features]
    return rows.join(F.broadcast(numbers), keys).withColumn(name, score("_model", *x)).drop("_model")


def tree_out_of_fold(
    rows: DataFrame, features: list[str], seasons: list[int], target: str = "target", season: str = "season",
    min_train: int = 30, keys: tuple[str, ...] = ("market",), settings: Boosting = Boosting(),
) -> DataFrame:
    """Walk-forward tree projections: every row under the model of the seasons before its own."""
    model = boost_folds(rows, list(keys), features, seasons, target, season, min_train, settings)
    return score_trees(rows, model, [*keys, season], features)


def blend(ridge: str | Column, tree: str | Column, family: str) -> Column:
    r = F.col(ridge) if isinstance(ridge, str) else ridge
    t = F.col(tree) if isinstance(tree, str) else tree
    w = BLENDS[family]
    return w * r + (1.0 - w) * t
