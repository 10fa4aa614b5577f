import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.llm import impacts, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, uid string, slice string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain(rows, k, scale, every):
    rows = [(i, whole(v, scale)) for i, v, *_ in rows if i is not None and usable(v)]
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            best = sorted((-dot(v, w), j) for b, (j, w) in enumerate(rows) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def made(seed, n=160, dim=9, spread=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(dim)], rnd.randrange(4), "x", "x", "x", "x") for i in range(n)]
    rows += rows[:20]  # repeated rows
    rows += [(1000 + i, rows[i][1], 1, "x", "x", "x", "x") for i in range(30)]  # ties
    odd = [[], [0.0] * dim, [1.0], [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, None]
    rows += [(2000 + 20 * i, v, 2, "x", "x", "x", "x") for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 1, "x", "x", "x", "x")]
    return rows


@pytest.mark.parametrize("seed,rows,spread", [(1, 16, 1.0), (2, 32, 0.02), (3, 4096, 5.0)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, rows, spread):
    monkeypatch.setattr(impacts, "BLOCK_ROWS", rows)
    monkeypatch.setattr(impacts, "BATCH_QUERIES", 5)
    monkeypatch.setattr(vectors, "LEAST_SLICE", 64)
    monkeypatch.setattr(vectors, "MOST_SLICE", 64)
    data = made(seed, spread=spread)
    got = impacts.top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, k=7, scale=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(data, 7, 64, 20)


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert impacts.top_k(empty, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, "", "", "", "")], SCHEMA)
    assert impacts.top_k(one, F.col("vec_id") % 20 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0], 1, "", "", "", ""), (7, [0.0], 1, "", "", "", "")], SCHEMA)
    assert [tuple(r) for r in impacts.top_k(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 7, 0)]


def test_segments_come_in_descending_impact():
    x = np.random.default_rng(0).normal(size=(50, 8)).round(1)
    places, ends = impacts.segments(x)
    impact = np.abs(x).ravel()[places]
    assert len(places) == np.count_nonzero(x) and ends[-1] == len(places)
    level = np.ceil(impact * impacts.LEVELS / impact.max())
    assert (np.diff(level) <= 0).all() and (level[ends[:-1]] < level[ends[:-1] - 1]).all()


def test_a_stop_rests_on_proof_and_spares_most_rows():
    """Sparse rows are settled before all segments are added."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random((400, 64)) < 0.05, rng.integers(5 * 10**5, 10**6, (400, 64)), rng.integers(-3, 4, (400, 64))).astype(float)
    places, ends = impacts.segments(x)

    class Record:
        uids, ids, size = np.arange(400).tobytes(), np.arange(400).tobytes(), 400
        vec, postings, segments = x.tobytes(), places.tobytes(), ends.tobytes()

    block = impacts.Block(Record, 64)
    added = []
    best = impacts.Best(3, 5, np.float64)
    queries = np.where(rng.random((3, 64)) < 0.1, 500.0, 0.0)

    class Noted(list):
        def __iter__(self):
            for part in list.__iter__(self):
                added.append(part)
                yield part

    block.rounds = Noted(block.rounds)
    impacts.search_block(block, queries, np.array([-1, -2, -3]), best, True)
    assert len(added) < len(block.rounds)
    for q in range(3):
        expected = sorted((-(x[i] @ queries[q]), i) for i in range(400))[:5]
        assert [(-s, i) for s, i, a in zip(best.scores, best.ids, best.q, strict=True) if a == q] == [(s, i) for s, i in expected]


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, [float(2**30 + 7 * i * i), float(3 * i + 1), -float(2**29)], 0, "", "", "", "") for i in range(60)]
    got = impacts.top_k(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.col("vec_id") % 20 == 0, k=60, scale=1)
    assert sorted(map(tuple, got.collect())) == sorted(
        (i, r, j, -s)
        for i, v, *_ in rows
        if i % 20 == 0
        for r, (s, j) in enumerate(sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w, *_ in rows if j != i), 1)
    )
