"""A keyed sink for update-mode streams: every batch writes its changed keys once.

A batch is a folder named by its id, written over when it is repeated, so replays change
nothing. The table is the latest row of every key; ``compact`` folds the batches
so far into one base, and reads open the base and what came after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UpsertSink:
    path: str
    keys: tuple[str, ...]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` body."""
        batch.write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id:012d}")

    def _parts(self, spark: SparkSession) -> tuple[int, list[str]]:
        """(last batch, folders to read): the newest base and the batches after it."""
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return -1, []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        done = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        found = sorted((int(m[2]), m[1], n) for n in done if (m := re.fullmatch(r"(base|delta)-(\d+)", n)))
        base = max((i for i, kind, _ in found if kind == "base"), default=-1)
        chosen = [(i, n) for i, kind, n in found if (i == base and kind == "base") or (i > base and kind == "delta")]
        return max((i for i, _ in chosen), default=-1), [f"{self.path}/{n}" for _, n in chosen]

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of every key."""
        _, parts = self._parts(spark)
        if not parts:
            raise FileNotFoundError(f"no batch at {self.path}")
        rows = None
        for p in parts:
            part = spark.read.parquet(p).withColumn("_batch", F.lit(int(p[-12:])))
            rows = part if rows is None else rows.unionByName(part)
        rest = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        return latest.select(*self.keys, "_r.*")

    def compact(self, spark: SparkSession) -> None:
        """Write the table as it is as a new base; older parts are no longer read."""
        last, parts = self._parts(spark)
        if len(parts) > 1:
            self.read(spark).write.mode("overwrite").parquet(f"{self.path}/base-{last:012d}")
