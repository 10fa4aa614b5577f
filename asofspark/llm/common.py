"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.session import checkpointed

__all__ = ["checkpointed", "column_of", "content_key", "in_parts", "table", "text_of", "unused"]

PART_ROWS = 1_000
"""Rows a worker turns into output at a time; Arrow batches may hold ten times as many."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_of(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case; for columns that are added and dropped again."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(column_of(df, name).cast("string"), F.lit(""))


def in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into parts, so that what a worker makes of them stays small."""
    for b in batches:
        for i in range(0, len(b), PART_ROWS):
            yield b.iloc[i : i + PART_ROWS]


def content_key(text: Column) -> Column:
    """128 bits that stand for a text; equal texts share them."""
    return F.unhex(F.md5(text))
