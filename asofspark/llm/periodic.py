"""Runs (maximal periodic stretches of words), from Lyndon arrays by suffix grouping.

The first phase of Baier's suffix sorter refines groups of suffixes, from the greatest
group down: a group's suffixes are closed, each gives its nearest open neighbour on the
left a longer prefix, and neighbours with the same old group and the same number of
closed suffixes form a new group above the old one. When a group is closed, the prefix
its suffixes share is the longest Lyndon word that starts there, so the phase yields the
Lyndon array without the sorter's second phase. It is run under both orders of the
alphabet; every run has a Lyndon root of one of them. Each root is extended both ways by
longest common extensions (exact ranks of 2^k-word windows); the roots whose extension
reaches the period are the runs.

Only stretches in which runs can lie are grouped: a run of at least ``least`` words and
twice its period q repeats, at distance q, ``least / 2`` words or more in a row, and the
windows of that many words which occur twice in the text cover all of it. Words outside
such windows are in no run; window hashes that collide only add words.

Texts are worked on one by one, whole, inside tasks, with time in proportion to their words
(times the logarithm of the longest stretch); nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from asofspark.llm.common import column_of, in_parts, text_of

LEAST = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PART_WORDS = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.dtype([("start", "<i8"), ("length", "<i8"), ("period", "<i8")])


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by suffix grouping."""
    n = len(word)
    members: list[list[int]] = []
    names: dict[int, int] = {}
    for c in sorted(set(word)):
        names[c] = len(members)
        members.append([])
    group = [names[c] for c in word]
    for i, g in enumerate(group):
        members[g].append(i)
    prefix = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left, right, out = list(range(-1, n)), list(range(1, n + 2)), [0] * n
    top = len(members) - 1
    while top >= 0:
        gain: dict[int, int] = {}
        size = prefix[top]
        for i in members[top]:
            if group[i] != top:
                continue
            out[i] = size
            p, q = left[i], right[i]
            left[q] = p
            if p >= 0:
                right[p] = q
                gain[p] = gain.get(p, 0) + 1
        members[top] = []
        if len(gain) == 1:
            ((p, k),) = gain.items()
            moved = [((group[p], k), [p])]
        else:
            together: dict[tuple[int, int], list[int]] = {}
            for p, k in gain.items():
                together.setdefault((group[p], k), []).append(p)
            moved = sorted(together.items())
        under, old = -1, -1
        for (g, k), places in moved:
            under = under if g == old else g
            old, new = g, len(members)
            members.append(places)
            prefix.append(prefix[g] + k * size)
            over = above[under]
            below.append(under)
            above.append(over)
            above[under] = new
            if over < new:
                below[over] = new
            for p in places:
                group[p] = new
            under = new
        top = below[top]
    return out


def repeated_stretches(ids: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """True for the words in a window of ``width`` words that occurs twice in its text."""
    count = max(len(ids) - width + 1, 0)
    h = text[:count].astype(np.uint64)
    for i in range(width):
        h = (h ^ ids[i : i + count].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text[:count] == text[width - 1 :][:count])
    if not len(whole):
        return np.zeros(len(ids), bool)
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = order[np.append(same, False) | np.append(False, same)]
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


class Extensions:
    """Longest common extensions over exact ranks of all windows of 2^k words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n = len(ids)
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.ranks) <= longest:
            r, half = self.ranks[-1], 2 ** (len(self.ranks) - 1)
            pair = r[: len(r) - half] * (len(r) + 1) + r[half:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))

    def _extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, span = self.ranks[k], 2**k
            x, y = (a, b) if step > 0 else (a - span, b - span)
            inside = np.flatnonzero((x >= 0) & (y >= 0) & (x < len(r)) & (y < len(r)))
            same = inside[r[x[inside]] == r[y[inside]]]
            a[same] += step * span
            b[same] += step * span
            size[same] += span
        return size

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and b on."""
        return self._extend(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before a and b."""
        return self._extend(a, b, -1)


def runs_of(stretches: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """The runs of every stretch, by start and period: at least ``least`` words and twice the period long."""
    if not stretches:
        return []
    sizes = np.array([len(s) for s in stretches], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    highest = max(int(s.max()) for s in stretches) + 1
    ids = np.concatenate([np.append(s, highest + i) for i, s in enumerate(stretches)])  # a mark of its own ends each
    extensions = Extensions(ids, int(sizes.max()))
    found = []
    for sign in (1, -1):
        roots = [lyndon_array((sign * s).tolist()) for s in stretches]
        period = np.concatenate([np.append(np.array(r, np.int64), len(ids)) for r in roots])
        at = np.flatnonzero(np.arange(len(ids)) + period < len(ids))
        p = period[at]
        after, before = extensions.forward(at, at + p), extensions.backward(at, at + p)
        long = before + p + after >= np.maximum(least, 2 * p)
        found.append(np.stack([at - before, before + p + after, p], 1)[long])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[owner]
    cuts = np.searchsorted(owner, np.arange(len(stretches) + 1))
    return [runs[cuts[i] : cuts[i + 1]] for i in range(len(stretches))]


def runs_in_texts(texts: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) of all runs of each text, given as words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    can = repeated_stretches(ids, text, (least + 1) // 2)
    # a stretch ends where the words cannot repeat, and with its text
    begins = np.flatnonzero(can & ~(np.append(False, can[:-1]) & np.append(False, text[1:] == text[:-1])))
    ends = np.flatnonzero(can & ~(np.append(can[1:], False) & np.append(text[1:] == text[:-1], False))) + 1
    wide = ends - begins >= least
    begins, ends = begins[wide], ends[wide]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for b, runs in zip(begins.tolist(), runs_of([ids[b:e] for b, e in zip(begins, ends, strict=True)], least), strict=True):
        if len(runs):
            t = int(text[b])
            out[t].append(runs + [b - first[t], 0, 0])
    return [np.concatenate(r) if r else np.empty((0, 3), np.int64) for r in out]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _by_words(texts: Iterator[list[str]]) -> Iterator[list[list[str]]]:
    """Texts in lists of about ``PART_WORDS`` words; a longer one is alone or last."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PART_WORDS:
            yield part
            part, size = [], 0
    yield part


def with_runs(df: DataFrame, keys: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """The key columns, n_words, runs (by start, then period) and collapsed, the text without repetitions.

    A null or empty text has no words, no runs and an empty collapsed text. Repeated
    rows are answered row by row; an empty table gives no rows. Columns that are not
    keys are left out, so their names cannot clash; a key may not be called n_words,
    runs or collapsed (ValueError).
    """
    taken = {"n_words", "runs", "collapsed"} & set(keys)
    if taken:
        raise ValueError(f"key columns may not be called {sorted(taken)}")
    told = df.select(*[column_of(df, k).alias(k) for k in keys], text_of(df, text).alias("collapsed"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            n, runs, left = [], [], []
            for part in _by_words(WORD.findall(t) for t in b.collapsed):
                for words, found in zip(part, runs_in_texts(part, least), strict=True):
                    n.append(len(words))
                    runs.append([dict(zip(_RUN.names, r, strict=True)) for r in found.tolist()])
                    left.append(collapsed(words, found))
            yield b.assign(n_words=n, runs=runs, collapsed=left)[[*keys, "n_words", "runs", "collapsed"]]

    made = StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return told.mapInPandas(mark, StructType(told.select(*keys).schema.fields + made.fields))
