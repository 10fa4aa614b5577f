"""Exact top-k inner products over an impact-ordered index, score at a time.

Index: rows are dealt into even slices and blocks of ``BLOCK_ROWS``. Every non-zero
component of a block is a posting; its impact is the component's size, quantised to
``LEVELS`` steps of the block's largest. Postings of one quantised impact make a
segment, segments are stored in descending impact.

Query: a block's segments are added to the accumulators of a batch of queries in
descending impact. What a row has not contributed yet is at most the query's norm
times the norm of the row's remaining postings, which bounds every score from both
sides. At the check points (``LEFT`` of the block's squares to come) a query stops when its
possible members, the rows whose upper bound reaches its k-th best proven score, are
no more than ``RESCORE_SHARE`` of the block; they are rescored exactly. A query that
never gets there adds all segments, where bounds and scores are the same. So a stop
only ever rests on proof, at any size.

Cells of (query group, slice) are worked on alone and return k rows a query, which one
window merges. A cell holds a slice and a group of bounded size; both numbers grow with
the tables, so no task does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofspark.llm import vectors
from asofspark.llm.common import checkpointed

BLOCK_ROWS = 4096
LEVELS = 64
LEFT = (1 / 16, 1 / 64, 1 / 256)
RESCORE_SHARE = 0.03
GROUP_QUERIES = 8192
BATCH_QUERIES = 256
RESCORE_PAIRS = 1 << 15

_BLOCK = "slice int, size int, uids binary, ids binary, vec binary, postings binary, segments binary"
_HIT = "query_uid bigint, query_id bigint, vec_id bigint, score bigint"


def segments(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(posting places, segment ends): places in the flattened block, by descending quantised impact."""
    impact = np.abs(x).ravel()
    places = np.flatnonzero(impact)
    if not len(places):
        return places.astype(np.uint32), np.empty(0, np.int64)
    level = np.ceil(impact[places] * (levels / impact.max())).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(level[order])) + 1, len(places))
    return places[order].astype(np.uint32), ends


def indexed(rows: DataFrame, slices: int) -> DataFrame:
    """The index of all rows: one record per block, written."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        out = []
        for i in range(0, len(pdf), BLOCK_ROWS):
            b = pdf.iloc[i : i + BLOCK_ROWS]
            x = vectors.matrix(b.vec)
            places, ends = segments(x)
            blobs = [b.uid.to_numpy("<i8"), b.vec_id.to_numpy("<i8"), x, places, ends]
            out.append([b.slice.iloc[0], len(b), *(v.tobytes() for v in blobs)])
        return pd.DataFrame(out, columns=["slice", "size", "uids", "ids", "vec", "postings", "segments"])

    dealt = rows.select("uid", "vec_id", "vec", vectors.share("uid", slices, "slice").alias("slice"))
    return checkpointed(dealt.groupBy("slice").applyInPandas(build, _BLOCK))


class Block:
    """A block with its postings spread out by rounds of segments, and what is left of every row after each."""

    def __init__(self, record, dim: int):
        self.uids, self.ids = np.frombuffer(record.uids, "<i8"), np.frombuffer(record.ids, "<i8")
        x = np.frombuffer(record.vec, "<f8").reshape(record.size, -1)
        places, ends = np.frombuffer(record.postings, "<u4"), np.frombuffer(record.segments, "<i8")
        square = np.cumsum(x.flat[places] ** 2)[ends - 1]
        cuts = sorted({int(ends[np.argmax(square >= (1 - s) * square[-1])]) for s in LEFT} | {len(places)}) if len(ends) else [0]
        self.rounds, self.rest, left, done = [], [], x * x, 0
        for cut in cuts:
            part = np.zeros(x.shape)
            part.flat[places[done:cut]] = x.flat[places[done:cut]]
            left.flat[places[done:cut]] = 0
            self.rounds.append(vectors.widened(part, dim))
            self.rest.append(np.sqrt(left.sum(1)))
            done = cut
        self.x = vectors.widened(x, dim)
        self.norms = np.sqrt((x * x).sum(1))
        self.row_of = {u: i for i, u in enumerate(self.uids.tolist())}


class Best:
    """The k best rows of every query so far."""

    def __init__(self, queries: int, k: int, dtype):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = np.append(self.q, q), np.append(self.ids, ids), np.append(self.scores, scores)
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = rank < self.k, rank == self.k - 1
        self.floor[q[last]] = scores[last]
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]


def search_block(block: Block, queries: np.ndarray, uids: np.ndarray, best: Best, exact: bool) -> None:
    """Adds a block's possible members to ``best``, exactly scored."""
    for start in range(0, len(queries), BATCH_QUERIES):
        at = np.arange(start, min(start + BATCH_QUERIES, len(queries)))
        own = [(i, block.row_of[u]) for i, u in enumerate(uids[at].tolist()) if u in block.row_of]
        norms = np.sqrt((queries[at] ** 2).sum(1))
        acc = np.zeros((len(at), len(block.x)))
        if own:
            acc[tuple(np.transpose(own))] = -np.inf
        for r, (part, rest) in enumerate(zip(block.rounds, block.rest, strict=True)):
            acc += queries[at] @ part.T
            slack = norms[:, None] * (rest * (1 + vectors.SLOPPY) + block.norms * vectors.SLOPPY)
            floor = best.floor[at]
            if len(block.x) > best.k:
                proven = -np.partition(slack - acc, best.k - 1, axis=1)[:, best.k - 1]
                floor = np.maximum(floor, proven)
            possible = (acc + slack >= floor[:, None]) & np.isfinite(acc)
            stop = possible.sum(1) <= RESCORE_SHARE * len(block.x) if r + 1 < len(block.rounds) else np.ones(len(at), bool)
            qi, rows = np.nonzero(possible & stop[:, None])
            for i in range(0, len(qi), RESCORE_PAIRS):
                a, b = at[qi[i : i + RESCORE_PAIRS]], rows[i : i + RESCORE_PAIRS]
                best.add(a, block.ids[b], vectors.products(queries[a], block.x[b], exact))
            at, acc, norms = at[~stop], acc[~stop], norms[~stop]
            if not len(at):
                break


def _cells(k: int):
    def search(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(queries):
            return pd.DataFrame({"query_uid": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q = vectors.matrix(queries.vec)
        dim = max(q.shape[1], *(len(v) // (8 * n) for v, n in zip(blocks.vec, blocks["size"], strict=True)))
        q, uids, ids = vectors.widened(q, dim), queries.uid.to_numpy(), queries.vec_id.to_numpy()
        parts: Iterator[Block] = (Block(b, dim) for b in blocks.sort_values("uids").itertuples())
        largest = max(float(np.abs(np.frombuffer(v, "<f8")).max(initial=0)) for v in blocks.vec)
        exact = largest * float(np.abs(q).max(initial=0)) * max(dim, 1) < 2**53
        best = Best(len(q), k, np.float64 if exact else np.int64)
        for block in parts:
            search_block(block, q, uids, best, exact)
        return pd.DataFrame({"query_uid": uids[best.q], "query_id": ids[best.q], "vec_id": best.ids, "score": best.scores.astype(np.int64)})

    return search


def top_k(df: DataFrame, queries: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query row with all other rows.

    ``queries`` is a condition on ``df``. Ties go to the smaller id. Rows with a
    null id, a null vector or a null or non-finite component take no part;
    shorter vectors count as filled up with zeros; a query with fewer than k
    other rows returns them all. A repeated row is another row: it is a candidate
    of its copies and, as a query, answered once for each copy. Other columns of
    any name are ignored; an empty table gives no rows. Scores must fit a long.
    """
    rows = vectors.packed(df, scale, queries, vec_id, vector)
    n, marked = rows.agg(F.count(F.lit(1)), F.count_if("marked")).first()
    slices, groups = vectors.slice_count(n), max(1, -(-marked // GROUP_QUERIES))
    blocks = indexed(rows, slices).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.where("marked").select("uid", "vec_id", "vec", vectors.share("uid", groups, "group").alias("grp"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    hits = blocks.groupBy("grp", "slice").cogroup(asked.groupBy("grp", "slice")).applyInPandas(_cells(k), _HIT)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
