import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_impacts import SCHEMA, dot, made, usable, whole

from asofspark.llm import anchortree, vectors


def plain(rows, every, scale=256, n_pos=5, n_neg=10):
    rows = [(i, whole(v, scale), label) for i, v, label, *_ in rows if i is not None and label is not None and usable(v)]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for b, (j, w, other) in enumerate(rows) if b != a)
        for s, j, _ in [t for t in scored if t[2] == label][:n_pos]:
            fits = [(-t, k) for t, k, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def clustered(seed, n=150):
    """Near copies around few centres, so that tree edges are short and bounds exclude rows."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, 0.05) for x in centres[i % 5]], rnd.randrange(3), "", "", "", "") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rows_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(anchortree, "TREE_ANCHORS", 6)
    monkeypatch.setattr(anchortree, "BUNDLE_ANCHORS", 8)
    monkeypatch.setattr(vectors, "LEAST_SLICE", 64)
    monkeypatch.setattr(vectors, "MOST_SLICE", 64)
    rows = clustered(seed) if seed == 3 else made(seed)
    rows += [(3000, rows[0][1], None, "", "", "", "")]
    got = anchortree.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 10)


def test_empty_tables_and_lone_rows(spark):
    every = F.col("vec_id") % 10 == 0
    assert anchortree.hard_negatives(spark.createDataFrame([], SCHEMA), every).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "", "", "", ""), (3, [1.0], 2, "", "", "", "")], SCHEMA)
    assert anchortree.hard_negatives(one, every).collect() == []


def test_spanning_tree_is_least_and_visits_parents_first():
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (40, 3)).astype(float)
    parent = anchortree.spanning_tree(x)
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    # Kruskal's total
    group, total = list(range(40)), 0.0
    for d, i, j in sorted((square[i, j], i, j) for i in range(40) for j in range(i)):
        if group[i] != group[j]:
            total += d
            group = [group[i] if g == group[j] else g for g in group]
    assert sum(square[i, p] for i, p in enumerate(parent) if p >= 0) == total
    order = anchortree.visiting_order(parent)
    assert sorted(order) == list(range(40))
    assert all(parent[i] < 0 or order.index(parent[i]) < order.index(i) for i in range(40))


def test_bounds_hold_and_exclude_rows_of_near_anchors():
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (300, 8)).astype(float)
    a = np.array([x[0], x[0] + 1, x[0] + 2])
    blobs = [np.arange(300, dtype="<i8").tobytes()] * 2 + [np.zeros(300, "<i8").tobytes(), x.tobytes()]
    record = type("R", (), dict(zip(["uids", "ids", "labels", "vec"], blobs, strict=True)))
    anchors = pd.DataFrame({
        "tree": [0, 0, 0], "place": [0, 1, 2], "parent": [-1, 0, 1], "edge": [0.0, 8**0.5, 8**0.5], "vec": [v.tobytes() for v in a],
    })
    rows = anchortree.Slice(record, anchors)
    least = np.sort(x @ a[0])[-10]
    seen = list(anchortree.walk(anchors, rows, lambda i: slice(0, 300), lambda i, low, high: (least, np.inf)))
    assert len(seen[0][2]) == 300
    for i, _, places, scores in seen[1:]:
        assert len(places) < 60
        assert set(np.flatnonzero(x @ a[i] >= least)) <= set(places.tolist())
        assert (scores == x[places] @ a[i]).all()
