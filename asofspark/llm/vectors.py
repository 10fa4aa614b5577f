"""Whole-number vectors in packed rows, and their division into even slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofspark.llm.common import checkpointed, column_of

LEAST_SLICE, MOST_SLICE = 4096, 32768
"""Rows of a slice: a small table is cut into about 32 slices, a large one into slices that fit a worker."""

SLOPPY = 1e-9
"""Share by which bounds are widened, far above the rounding of doubles."""


def packed(df: DataFrame, scale: int, marked: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """Rows that take part: uid, vec_id, label, marked and the vector as packed doubles ``floor(scale * x)``.

    Rows with a null id, vector or label (where one is asked for), or with a
    null or non-finite component take no part. Shorter vectors count as filled
    up with zeros. Repeated rows stay apart (own ``uid``). The result is a
    written table, so that ``uid`` is the same in every later job.
    """
    out = df.select(
        column_of(df, vec_id).cast("bigint").alias("vec_id"),
        (column_of(df, label) if label else F.lit(0)).cast("bigint").alias("label"),
        F.coalesce(marked, F.lit(False)).alias("marked"),
        column_of(df, vector).cast("array<double>").alias("vec"),
    ).dropna(subset=["vec_id", "label", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values
            x = values.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | np.asarray(values.is_null()))])
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            with np.errstate(invalid="ignore"):
                data = np.floor(x * scale).tobytes()
            blob = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(data)])
            kept = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("marked"), blob], ["vec_id", "label", "marked", "vec"])
            yield kept.filter(pa.array(good))

    rows = out.mapInArrow(pack, "vec_id bigint, label bigint, marked boolean, vec binary")
    return checkpointed(rows.withColumn("uid", F.monotonically_increasing_id()))


def matrix(blobs, dim: int | None = None) -> np.ndarray:
    """Packed vectors as rows of a matrix, filled up with zeros."""
    blobs = list(blobs)
    wide = max([dim or 0, *(len(b) // 8 for b in blobs)])
    if all(len(b) == 8 * wide for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), wide)
    return np.frombuffer(b"".join(b.ljust(8 * wide, b"\0") for b in blobs), "<f8").reshape(len(blobs), wide)


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return widened(a, dim), widened(b, dim)


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """True where no inner product or partial sum can leave the whole numbers a double holds."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2**53


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Row-by-row inner products; in long arithmetic where doubles could round."""
    if exact:
        return np.einsum("ij,ij->i", a, b)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def slice_count(rows: int) -> int:
    return max(1, -(-rows // min(MOST_SLICE, max(LEAST_SLICE, rows // 32))))


def share(column: str, parts: int, seed: str) -> Column:
    """An even part number from 0, by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(parts)).cast("int")
