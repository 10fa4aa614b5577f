"""Hard negatives by spanning-tree bounds between anchors.

The scores of a row x at two anchors differ by at most the anchors' distance times
the norm of x. Anchors are therefore joined to a minimum spanning tree (within groups
of near anchors, found by pivots), and scores pass from parent to child as intervals:
the parent's interval, plus or minus edge length times candidate norm. Only rows whose
interval overlaps the window that the child asks for are scored again, exactly; the
others keep their interval and pass it on. A root scores all rows.

Two walks over the tree: the first asks, among rows of the anchor's own label, for the
window from its proven n-th best score upwards (positives); the second, among all other
rows, for the windows that the positives' scores span (negatives).

Cells of (group bundle, slice of rows) are worked on alone: each returns at most n rows an
anchor, or n a positive, and a window merges them. Slices and groups have bounded
size, their numbers grow with the tables. Where the anchors lie far apart the bounds
exclude little and nearly all rows are scored, which costs time but no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm import vectors
from asofspark.llm.common import checkpointed

TREE_ANCHORS = 512
BUNDLE_ANCHORS = 4096
MAX_PIVOTS = 4096
"""Pivots only say which anchors share a tree; beyond this many, trees of one pivot are split by hash."""

_TREE = "tree int, place int, parent int, edge double, uid bigint, vec_id bigint, label bigint, vec binary"


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """Parent of every row in a minimum spanning tree of the rows, -1 for row 0 (Prim)."""
    n = len(x)
    parent, square = np.full(n, -1), (x * x).sum(1)
    near = np.full(n, np.inf)
    joined, source, at = np.zeros(n, bool), np.full(n, -1), 0
    for _ in range(n - 1):
        joined[at] = True
        far = np.maximum(square + square[at] - 2 * (x @ x[at]), 0)
        closer = (far < near) & ~joined
        near[closer], source[closer] = far[closer], at
        at = int(np.argmin(np.where(joined, np.inf, near)))
        parent[at] = source[at]
    return parent


def visiting_order(parent: np.ndarray) -> list[int]:
    """Depth first, the largest subtree of a node last, so that few open nodes are ever held."""
    children: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(i)
    down, size = [0] if len(parent) else [], [1] * len(parent)
    for i in down:
        down += children[i]
    for i in reversed(down):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    order, stack = [], down[:1]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(children[i], key=lambda c: -size[c])
    return order


def _rooted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", ignore_index=True)
    x = vectors.matrix(pdf.vec)
    parent = spanning_tree(x)
    order = visiting_order(parent)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    edge = np.where(parent >= 0, np.sqrt(((x - x[parent]) ** 2).sum(1)), 0.0)
    pdf["place"], pdf["parent"], pdf["edge"] = place, np.where(parent >= 0, place[parent], -1), edge
    return pdf[["tree", "place", "parent", "edge", "uid", "vec_id", "label", "vec"]]


def trees(rows: DataFrame, anchors: int) -> DataFrame:
    """The anchors with tree, visiting place, parent's place and edge length, written."""
    marked = rows.where("marked")
    some = marked.orderBy(F.xxhash64("uid"), "uid").limit(min(MAX_PIVOTS, -(-anchors // TREE_ANCHORS))).select("vec").collect()
    pivots = vectors.matrix(r.vec for r in some) if some else np.zeros((1, 1))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, p = vectors.same_width(vectors.matrix(b.vec), pivots)
            yield b.assign(pivot=np.argmin((p * p).sum(1) - 2 * x @ p.T, axis=1).astype("int32") if len(b) else [])

    placed = checkpointed(marked.mapInPandas(nearest, "vec_id bigint, label bigint, marked boolean, vec binary, uid bigint, pivot int"))
    counts = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE_ANCHORS).cast("int").alias("parts"))
    firsts = counts.withColumn("first", F.coalesce(F.sum("parts").over(Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tree = (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int")
    told = placed.join(firsts, "pivot").select("uid", "vec_id", "label", "vec", tree.alias("tree"))
    return checkpointed(told.groupBy("tree").applyInPandas(_rooted, _TREE))


_SLICE = "slice int, uids binary, ids binary, labels binary, vec binary"


def sliced(rows: DataFrame, slices: int) -> DataFrame:
    """All rows, a record per slice, in order of label, written."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "vec_id", "uid"])
        blobs = [pdf.uid.to_numpy("<i8"), pdf.vec_id.to_numpy("<i8"), pdf.label.to_numpy("<i8"), vectors.matrix(pdf.vec)]
        return pd.DataFrame([[pdf.slice.iloc[0], *(b.tobytes() for b in blobs)]], columns=["slice", "uids", "ids", "labels", "vec"])

    dealt = rows.select("uid", "vec_id", "label", "vec", vectors.share("uid", slices, "slice").alias("slice"))
    return checkpointed(dealt.groupBy("slice").applyInPandas(pack, _SLICE))


class Slice:
    def __init__(self, record, anchors: pd.DataFrame):
        self.uids, self.ids, self.labels = (np.frombuffer(b, "<i8") for b in (record.uids, record.ids, record.labels))
        self.x, self.a = vectors.same_width(np.frombuffer(record.vec, "<f8").reshape(len(self.ids), -1), vectors.matrix(anchors.vec))
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.exact = vectors.exact_in_doubles(self.x, self.a)
        if not self.exact:
            self.x, self.a = self.x.astype(np.int64), self.a.astype(np.int64)

    def scores(self, anchor: int, part: slice, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted rows of a part."""
        x = self.x[part]
        return (x @ self.a[anchor])[wanted] if 2 * np.count_nonzero(wanted) > len(wanted) else x[wanted] @ self.a[anchor]


def bounds_from(parent: tuple | None, edge: float, norms: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """A child's score intervals, from its parent's; none are known at a root."""
    if parent is None:
        return np.full(len(norms), -np.inf), np.full(len(norms), np.inf)
    slack = norms * (edge * (1 + vectors.SLOPPY) + reach * vectors.SLOPPY)
    return parent[0] - slack, parent[1] + slack


def walk(anchors: pd.DataFrame, rows: Slice, part_of, window_of) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(anchor, part of the slice, places in the part, exact scores) down the trees.

    ``part_of(i)`` names the rows an anchor looks at, ``window_of(i, low, high)`` the
    scores it asks for. A child in another part than its parent starts anew.
    """
    open_nodes: dict[tuple[int, int], tuple] = {}
    key = list(zip(anchors.tree.tolist(), anchors.parent.tolist(), strict=True))
    waiting = pd.Series(key).value_counts().to_dict()
    reach = np.sqrt((rows.a.astype(float) ** 2).sum(1))
    for i, (tree, place, edge) in enumerate(zip(anchors.tree.tolist(), anchors.place.tolist(), anchors.edge.tolist(), strict=True)):
        part, parent = part_of(i), open_nodes.get(key[i])
        known = parent[1:] if parent and parent[0] == part else None
        low, high = bounds_from(known, edge, rows.norms[part], reach[i])
        least, most = window_of(i, low, high)
        wanted = (high >= least) & (low <= most)
        scores = rows.scores(i, part, wanted)
        low[wanted] = high[wanted] = scores
        waiting[key[i]] -= 1
        if not waiting[key[i]]:
            open_nodes.pop(key[i], None)
        if waiting.get((tree, place)):
            open_nodes[tree, place] = (part, low, high)
        yield i, part, np.flatnonzero(wanted), scores


def _positives(n: int):
    def cell(slices: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor_uid", "anchor_id", "positive_id", "score"]
        if not len(slices) or not len(anchors):
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        anchors = anchors.sort_values(["tree", "place"], ignore_index=True)
        rows = Slice(next(slices.itertuples()), anchors)
        first, last = (np.searchsorted(rows.labels, anchors.label.to_numpy(), side) for side in ("left", "right"))

        def window(i, low, high):
            # one more than asked for, since the anchor itself may be among them
            return (-np.partition(-low, n)[n] if len(low) > n else -np.inf), np.inf

        out = []
        for i, part, places, scores in walk(anchors, rows, lambda i: slice(int(first[i]), int(last[i])), window):
            other = rows.uids[part][places] != anchors.uid[i]
            ids, scores = rows.ids[part][places][other], scores[other]
            best = np.lexsort((ids, -scores))[:n]
            out.append((np.full(len(best), anchors.uid[i]), np.full(len(best), anchors.vec_id[i]), ids[best], scores[best].astype(np.int64)))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return cell


def _negatives(n: int, low_percent: int, high_percent: int):
    def cell(slices: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor_uid", "rank_of_positive", "negative_id", "score"]
        if not len(slices) or not len(anchors):
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        anchors = anchors.sort_values(["tree", "place"], ignore_index=True)
        rows = Slice(next(slices.itertuples()), anchors)
        every = slice(0, len(rows.ids))
        spans = [[(-(-low_percent * s // 100), high_percent * s // 100) for s in map(int, p)] for p in anchors.positive_scores]
        edges = [(min((a for a, b in s if a <= b), default=np.inf), max((b for a, b in s if a <= b), default=-np.inf)) for s in spans]

        out = []
        for i, _, places, scores in walk(anchors, rows, lambda i: every, lambda i, low, high: edges[i]):
            fits = (scores >= edges[i][0]) & (scores <= edges[i][1]) & (rows.labels[places] != anchors.label[i])
            ids, scores = rows.ids[places][fits], scores[fits].astype(np.int64)
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            for rank, (least, most) in enumerate(spans[i], 1):
                begin = np.searchsorted(-scores, -most)
                end = min(np.searchsorted(-scores, -least, "right"), begin + n)
                if begin < end:
                    out.append((np.full(end - begin, anchors.uid[i]), np.full(end - begin, rank), ids[begin:end], scores[begin:end]))
        if not out:
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return cell


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``df``. An anchor's positives are its best other
    rows of the same label; a positive's negatives are the best rows of other labels
    with a score from ``low_percent`` to ``high_percent`` of the positive's (none, where
    that is negative). Ties go to the smaller id. Rows with a null id, label or
    vector, or with a null or non-finite component take no part; shorter vectors
    count as filled up with zeros. Repeated rows are rows of their own: a copy may be
    an anchor's positive, and every copy of an anchor has its own results. Other
    columns of any name are ignored; an empty table gives no rows. Scores must fit a
    long.
    """
    rows = vectors.packed(df, scale, anchors, vec_id, vector, label)
    n, marked = rows.agg(F.count(F.lit(1)), F.count_if("marked")).first()
    slices, bundles = vectors.slice_count(n), max(1, -(-marked // BUNDLE_ANCHORS))
    planted = trees(rows, marked)
    bundled = lambda d: d.withColumn("bundle", F.pmod("tree", F.lit(bundles)))
    spread = lambda d: bundled(d).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    table = sliced(rows, slices).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    cells = table.groupBy("bundle", "slice")

    near = cells.cogroup(spread(planted).groupBy("bundle", "slice")).applyInPandas(
        _positives(positives), "anchor_uid bigint, anchor_id bigint, positive_id bigint, score bigint"
    )
    order = Window.partitionBy("anchor_uid").orderBy(F.desc("score"), "positive_id")
    found = checkpointed(near.withColumn("rank_of_positive", F.row_number().over(order)).where(F.col("rank_of_positive") <= positives))

    told = F.sort_array(F.collect_list(F.struct("rank_of_positive", "score")))
    asked = found.groupBy(F.col("anchor_uid").alias("uid")).agg(F.transform(told, lambda p: p.score).alias("positive_scores"))
    windows = planted.join(asked, "uid", "left").withColumn("positive_scores", F.coalesce("positive_scores", F.array().cast("array<bigint>")))
    far = cells.cogroup(spread(windows).groupBy("bundle", "slice")).applyInPandas(
        _negatives(negatives, low_percent, high_percent), "anchor_uid bigint, rank_of_positive int, negative_id bigint, score bigint"
    )
    order = Window.partitionBy("anchor_uid", "rank_of_positive").orderBy(F.desc("score"), "negative_id")
    chosen = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return (
        found.withColumnRenamed("score", "positive_score")
        .join(chosen.withColumnRenamed("score", "negative_score"), ["anchor_uid", "rank_of_positive"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
