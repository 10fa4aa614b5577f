"""Repeated byte strings, by run-length Burrows-Wheeler indexes over anchored segments.

Every string of ``LENGTH`` bytes has one anchor: the least-hashed ``GRAM``-byte
gram in it, leftmost on ties. Equal strings have equal anchors at equal places,
so only texts around anchors that occur twice need to meet. The windows that
share an anchor make one segment of a text; segments are shuffled by anchor, and
equal segments are one entry with a count. Each task then builds, for about
``INDEX_BYTES`` of segments at a time, the Burrows-Wheeler transform, compresses it
to runs, and takes matches with the neighbouring suffixes only at the ends of runs,
where alone they cannot be derived. Matching statistics are streamed from those
samples along the text: inside a run a match is that of the position before, less
one. Windows whose statistic reaches ``LENGTH`` are marked.

Equal texts are indexed once, with a count. An anchor with more than
``MAX_SEGMENTS`` different segments is split: its windows are counted by their own
digests, map-side first, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm.common import checkpointed, column_of, content_key, in_parts, text_of

LENGTH = 400
GRAM = 64
INDEX_BYTES = 1 << 20
MAX_SEGMENTS = 4096

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every gram of ``GRAM`` bytes."""
    h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    span = 8
    for m in _MULTIPLIERS:
        h *= m
        h ^= h >> np.uint64(31)
        if span < GRAM:
            h = h[:-span] * np.uint64(3) + h[span:]
            span *= 2
    return h


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, last window) of the anchors in order; an anchor's windows follow those of the anchor before."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = gram_hashes(data)
    places = np.arange(len(h), dtype=np.uint64)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | places
    w = length - GRAM + 1
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(v)] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)
    last = np.append(np.flatnonzero(least[1:] != least[:-1]), n - 1)
    return h[least[last].astype(np.int64)].view(np.int64), last.astype(np.int32)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling up to ``depth`` bytes."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # 0: past the end

    def number(slots: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
        """Give each suffix its group's first slot; returns the slots of groups that are not single."""
        new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
        first = np.flatnonzero(new)
        rank[order[slots]] = (slots[first] + 1)[np.cumsum(new) - 1]
        sizes = np.diff(np.append(first, len(slots)))
        return slots[np.repeat(sizes > 1, sizes)]

    open_slots = number(np.arange(n), key[order])
    span = 8
    while span < depth and len(open_slots):
        at = order[open_slots]
        pair = rank[at] * np.int64(n + 1) + rank[np.minimum(at + span, n)]
        by = np.argsort(pair, kind="stable")
        order[open_slots] = at[by]
        open_slots = number(open_slots, pair[by])
        span *= 2
    return order


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, up to ``most``."""
    padded = np.zeros(len(data) + 8 + most, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + most,), "<u8", padded.tobytes(), strides=(1,))
    out = np.full(len(a), most, np.int64)
    live = np.arange(len(a))
    for k in range(0, most, 8):
        diff = words[a[live] + k] ^ words[b[live] + k]
        done = diff != 0
        if done.any():
            d = diff[done]
            low = d & (~d + np.uint64(1))
            out[live[done]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            live = live[~done]
            if not len(live):
                break
    return np.minimum(out, most)


def matching_statistics(segments: list[bytes]) -> np.ndarray:
    """For each position of the segments, joined by one byte that no text has, a longest match elsewhere.

    Exact where it reaches no further than the segments' ends. The index is kept as runs: only at a run's
    first and last position is the match with the neighbour outside the run taken from the text.
    """
    data = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    n, most = len(data), max(map(len, segments)) + 1
    order = suffix_order(data, most)
    transform = data[order - 1]
    ends = np.flatnonzero((transform[1:] != transform[:-1]) | (transform[1:] == 255))  # last slots of runs; a segment's start is a run of its own
    above, below = order[ends], order[ends + 1]  # sampled positions on both sides of each run's end
    matched = common_prefix(data, above, below, most)
    sampled = np.zeros(n, np.int64)
    np.maximum.at(sampled, above, matched)
    np.maximum.at(sampled, below, matched)
    places = np.arange(n)
    return np.maximum.accumulate(sampled + places) - places


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Starts within each segment of the windows of ``length`` that also start elsewhere in the segments."""
    stats = matching_statistics(segments)
    out, at = [], 0
    for s in segments:
        out.append(np.flatnonzero(stats[at : at + max(0, len(s) - length + 1)] >= length))
        at += len(s) + 1
    return out


def _bounds(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive starts."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (anchor, digest, copies, segment) in the order of anchors to marked stretches of windows."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pd.DataFrame:
        out, by = [], {}
        for r in rows:
            by.setdefault(r[0], []).append(r)
        shared = [r for g in by.values() if len(g) > 1 for r in g]  # a lone segment can only repeat as a whole
        found = repeated_windows([r[3] for r in shared]) if shared else []
        for r, starts in zip(shared, found, strict=True):
            if r[2] == 1 and len(starts):
                firsts, lasts = _bounds(starts)
                out += [(r[0], r[1], int(a), int(b)) for a, b in zip(firsts, lasts, strict=True)]
        out += [(r[0], r[1], 0, len(r[3]) - LENGTH) for r in rows if r[2] > 1]
        return pd.DataFrame(out, columns=["anchor", "digest", "first", "last"])

    for b in batches:
        for r in zip(b["anchor"], b["digest"], b["copies"], b["segment"], strict=True):
            if size > INDEX_BYTES and r[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(r)
            size += len(r[3])
    if held:
        yield flush(held)


def _window_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of segments one by one, for anchors with too many segments."""
    for b in batches:
        for h, d, c, s in zip(b["anchor"], b["digest"], b["copies"], b["segment"], strict=True):
            n = len(s) - LENGTH + 1
            yield pd.DataFrame(
                {"anchor": [h] * n, "digest": [d] * n, "copies": [c] * n, "start": range(n), "window": [hashlib.md5(s[i : i + LENGTH]).digest() for i in range(n)]}
            )


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in in_parts(batches):
        found = [anchors(t.encode()) for t in b["text"]]
        yield pd.DataFrame({"key": b["key"], "anchors": [h for h, _ in found], "lasts": [x for _, x in found]})


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments around repeated anchors; a segment's bytes come with its first occurrence in a text."""
    import xxhash

    for b in in_parts(batches):
        out = []
        for key, text, copies, firsts, lasts, hashes in zip(b["key"], b["text"], b["copies"], b["firsts"], b["lasts"], b["anchors"], strict=True):
            data, seen = text.encode(), set()
            for i, j, h in zip(firsts, lasts, hashes, strict=True):
                s = data[i : j + LENGTH]
                d = xxhash.xxh3_128_digest(s)
                out.append((key, int(i), h, d, min(copies, 2), None if (h, d) in seen else s))
                seen.add((h, d))
        yield pd.DataFrame(out, columns=["key", "start", "anchor", "digest", "copies", "segment"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and their marked stretches to what is removed and left."""
    for b in in_parts(batches):
        out = []
        for key, text, firsts, lasts in zip(b["key"], b["text"], b["firsts"], b["lasts"], strict=True):
            data = text.encode()
            spans, kept, at = [], hashlib.sha256(), 0
            for i, j in sorted(zip(firsts, lasts, strict=True)):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], j + LENGTH)
                else:
                    spans.append([i, j + LENGTH])
            for i, j in spans:
                kept.update(data[at:i])
                at = j
            kept.update(data[at:])
            out.append((key, sum(j - i for i, j in spans), len(spans), kept.hexdigest(), [int(i) for i, _ in spans], [int(j) for _, j in spans]))
        yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def marked_windows(segments: DataFrame) -> DataFrame:
    """(anchor, digest, first, last) of repeated windows, from distinct segments with their counts."""
    many = checkpointed(segments.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_SEGMENTS).select("anchor"))
    ordered = segments.join(many, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    marks = ordered.select("anchor", "digest", "copies", "segment").mapInPandas(_index, "anchor long, digest binary, first int, last int")
    if many.isEmpty():
        return marks
    windows = checkpointed(
        segments.join(many, "anchor", "left_semi")
        .select("anchor", "digest", "copies", "segment")
        .mapInPandas(_window_digests, "anchor long, digest binary, copies long, start int, window binary")
    )
    twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window")
    single = windows.join(twice, "window", "left_semi")
    return marks.unionByName(single.select("anchor", "digest", F.col("start").alias("first"), F.col("start").alias("last")))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, starts, ends) of the texts that lose bytes, keyed by content, written once."""
    body = docs.select(content_key(text_of(docs, text)).alias("key"), text_of(docs, text).alias("text"))
    long = body.filter(F.octet_length("text") >= LENGTH)
    found = checkpointed(long.mapInPandas(_anchor_rows, "key binary, anchors array<long>, lasts array<int>"))
    each = found.select("key", F.posexplode(F.arrays_zip("anchors", "lasts")).alias("k", "a"), "lasts").select(
        "key", F.col("a.anchors").alias("anchor"), F.when(F.col("k") > 0, F.col("lasts")[F.greatest(F.col("k") - 1, F.lit(0))] + 1).otherwise(0).alias("first"), F.col("a.lasts").alias("last")
    )
    # written, so that the join meets two plain shuffles and a very common anchor is split over tasks
    twice = checkpointed(found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    shared = each.join(twice, "anchor", "left_semi").distinct()
    per_text = shared.groupBy("key").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    texts = long.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    near = checkpointed(texts.join(per_text, "key"))

    pieces = checkpointed(
        near.select("key", "text", "copies", "firsts", "lasts", "anchors").mapInPandas(
            _segments, "key binary, start int, anchor long, digest binary, copies long, segment binary"
        )
    )
    distinct = checkpointed(pieces.groupBy("anchor", "digest").agg(F.sum("copies").alias("copies"), F.max("segment").alias("segment")))
    marks = checkpointed(marked_windows(distinct))
    spans = pieces.select("key", "start", "anchor", "digest").join(marks, ["anchor", "digest"]).select(
        "key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")
    )
    per = spans.groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    out = near.select("key", "text").join(per, "key").select("key", "text", "firsts", "lasts")
    return checkpointed(out.mapInPandas(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte ranges, per document.

    Null texts are empty. Every row appears, and rows with equal texts all lose
    what is repeated, as do repeated rows. Other columns are not read. Texts under
    ``LENGTH`` bytes lose nothing.
    """
    per = repeated_spans(docs, text)
    rows = docs.select(
        column_of(docs, id_col).alias("doc_id"),
        content_key(text_of(docs, text)).alias("key"),
        F.octet_length(text_of(docs, text)).cast("bigint").alias("n_bytes"),
        F.sha2(text_of(docs, text).cast("binary"), 256).alias("whole"),
    )
    return rows.join(per, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        "starts",
        "ends",
    )
