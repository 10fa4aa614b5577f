"""Append-only ledgers over plain files.

A ledger is a folder of run folders plus a manifest folder with one row per
published run; readers see only published runs, and publishing is the last
step, so a failed run leaves the ledger as it was. One writer at a time is
assumed: plain files offer no lock.

A run is laid out by key bucket and period, and an index holds a bitmap of hashed keys
for each part. An append compares the bitmaps of its own keys with those of the same
bucket and period, and opens only the parts that may hold one of its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.functions.scalars import content_hash
from asofspark.session import checkpointed

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("published_at", T.TimestampType(), False),
    ]
)
PART = ["_bucket", "_period"]
INDEX = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("_bucket", T.IntegerType()),
        T.StructField("_period", T.StringType()),
        T.StructField("keys", T.BinaryType()),
    ]
)
BITS = 32768
"""Bits of a part's bitmap: those of Spark's bitmap functions."""


class LedgerConflict(ValueError):
    """An existing key has other content."""


@dataclass(frozen=True)
class Ledger:
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    transient: tuple[str, ...] = ("retrieved_at_utc", "content_hash")
    period: str | None = None
    """A key column whose values come in runs, such as a season or a week."""
    buckets: int = 16

    def runs(self, spark: SparkSession) -> DataFrame:
        return _read_or_empty(spark, f"{self.path}/manifest", MANIFEST)

    def read(self, spark: SparkSession) -> DataFrame:
        """All published rows; rows of unpublished runs stay invisible.

        The run id is the partition column, so unpublished folders are pruned.
        """
        stored = T.StructType([*self.schema.fields, *INDEX.fields[:3]])
        rows = _read_or_empty(spark, f"{self.path}/runs", stored)
        return rows.join(self.runs(spark).select("run_id"), "run_id", "left_semi").select(*self.schema.names)

    def _placed(self, rows: DataFrame) -> DataFrame:
        period = F.lit("all") if self.period is None else F.coalesce(F.col(self.period).cast("string"), F.lit("none"))
        return rows.withColumns({"_bucket": F.pmod(self._hash("bucket"), F.lit(self.buckets)).cast("int"), "_period": period})

    def _hash(self, seed: str) -> Column:
        return F.xxhash64(F.lit(seed), *[F.col(k) for k in self.keys])

    def _bitmaps(self, placed: DataFrame) -> DataFrame:
        """One bitmap of hashed keys per bucket and period; its size does not follow the rows."""
        bit = F.bitmap_bit_position(F.pmod(self._hash("bit"), F.lit(BITS)) + 1)
        return placed.groupBy(*PART).agg(F.bitmap_construct_agg(bit).alias("keys"))

    def parts_that_may_hold(self, batch: DataFrame) -> list[tuple[str, int, str]]:
        """(run, bucket, period) of the published parts that share a bit with the batch's keys; names alone reach the driver."""
        spark = batch.sparkSession
        mine = self._bitmaps(self._placed(batch.select(*self.schema.names)))
        index = _read_or_empty(spark, f"{self.path}/index", INDEX)
        near = index.join(self.runs(spark).select("run_id"), "run_id", "left_semi").join(mine.withColumnRenamed("keys", "_mine"), PART)
        both = near.select("run_id", *PART, F.explode(F.array("keys", "_mine")).alias("k"))
        shared = both.groupBy("run_id", *PART).agg(F.bitmap_count(F.bitmap_and_agg("k")).alias("n")).filter("n > 0")
        return [(r[0], r[1], r[2]) for r in shared.select("run_id", *PART).collect()]

    def candidates(self, batch: DataFrame) -> DataFrame:
        """The rows of the parts that may hold a key of the batch; no other file is opened."""
        spark = batch.sparkSession
        folders = [f"{self.path}/runs/run_id={_escaped(spark, run)}/_bucket={b}/_period={_escaped(spark, p)}" for run, b, p in self.parts_that_may_hold(batch)]
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def append(self, batch: DataFrame, run_id: str) -> dict[str, int]:
        """Insert new keys, count unchanged ones, fail when content differs.

        A run id that is already published is a repeat and does nothing.
        """
        spark = batch.sparkSession
        done = self.runs(spark).filter(F.col("run_id") == run_id).select("rows").head()
        if done is not None:
            return {"inserted": 0, "unchanged": int(done["rows"])}
        batch = checkpointed(batch.select(*self.schema.names))
        graded = checkpointed(classify(batch, self.candidates(batch), self.keys, self.transient))
        counts = graded.groupBy("_status").agg(F.count(F.lit(1)).alias("n")).collect()
        by = {r["_status"]: r["n"] for r in counts}
        if by.get("CONFLICT"):
            sample = graded.filter("_status = 'CONFLICT'").select(*self.keys).limit(3).collect()
            raise LedgerConflict(f"{by['CONFLICT']} rows differ from the ledger, e.g. {[tuple(r) for r in sample]}")
        new = self._placed(graded.filter("_status = 'NEW'").select(*self.schema.names))
        new.hint("rebalance", *PART).write.mode("overwrite").partitionBy(*PART).parquet(f"{self.path}/runs/run_id={run_id}", compression="zstd")
        marks = self._bitmaps(new).select(F.lit(run_id).alias("run_id"), *PART, "keys")
        marks.coalesce(1).write.mode("append").parquet(f"{self.path}/index")
        row = spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(by.get("NEW", 0)).cast("long").alias("rows"), F.current_timestamp().alias("published_at")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return {"inserted": by.get("NEW", 0), "unchanged": by.get("UNCHANGED", 0)}


def _escaped(spark: SparkSession, name: str) -> str:
    """A partition value as it stands in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def classify(batch: DataFrame, existing: DataFrame, keys: tuple[str, ...], transient: tuple[str, ...]) -> DataFrame:
    """Each batch row as NEW, UNCHANGED or CONFLICT.

    Keys repeated inside the batch are reduced first: equal content counts
    once, different content is a conflict.
    """
    hashed = batch.withColumn("_hash", content_hash(batch, tuple(transient)))
    rest = [c for c in batch.columns if c not in keys]
    one = hashed.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "_hash").alias("_r"), F.min("_hash").alias("_hash"), F.max("_hash").alias("_hash_max")
    )
    # only ledger rows whose key recurs are hashed; a small batch is broadcast here by size
    recurring = existing.join(one.select(*keys), list(keys), "left_semi").select(*existing.columns)
    old = recurring.select(*keys, content_hash(existing, tuple(transient)).alias("_old"))
    joined = one.join(old, list(keys), "left")
    status = (
        F.when(F.col("_hash") != F.col("_hash_max"), F.lit("CONFLICT"))
        .when(F.col("_old").isNull(), F.lit("NEW"))
        .when(F.col("_old") == F.col("_hash"), F.lit("UNCHANGED"))
        .otherwise(F.lit("CONFLICT"))
    )
    return joined.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], status.alias("_status")).select(*batch.columns, "_status")


def attempt_state(events: DataFrame, key: str = "idempotency_key", status: str = "status", seq: str = "attempt", payload: str = "payload_hash") -> DataFrame:
    """Latest status, attempts and payload conflicts per idempotency key."""
    return events.groupBy(key).agg(
        F.max_by(status, seq).alias("latest_status"),
        F.max(seq).alias("attempts"),
        (F.min(payload) != F.max(payload)).alias("conflict"),
    )


def illegal_transitions(events: DataFrame, legal: list[tuple[str | None, str]], key: str = "idempotency_key", status: str = "status", seq: str = "attempt") -> DataFrame:
    """Status changes outside the legal list.

    The predecessor of a row is found by an equi-join on the sequence number,
    so a key with very many attempts is still spread over tasks.
    """
    now = events.select(key, seq, status)
    before = events.select(key, (F.col(seq) + 1).alias(seq), F.col(status).alias("_before"))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in legal]
    step = F.struct(F.col("_before").alias("a"), F.col(status).alias("b"))
    known = F.exists(F.array(*pairs), lambda p: p["a"].eqNullSafe(step["a"]) & p["b"].eqNullSafe(step["b"]))
    return now.join(before, [key, seq], "left").filter(~known).select(key, seq, F.col("_before").alias("from_status"), F.col(status).alias("to_status"))


def slot_completeness(expected: DataFrame, quotes: DataFrame, predictions: DataFrame, keys: list[str], purpose: str = "purpose") -> DataFrame:
    """Expected slots with quote and prediction counts; only DECISION slots need predictions."""
    q = quotes.groupBy(*keys).agg(F.count(F.lit(1)).alias("quotes"))
    p = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"))
    full = expected.join(q, keys, "left").join(p, keys, "left")
    nq, np_ = F.coalesce("quotes", F.lit(0)), F.coalesce("predictions", F.lit(0))
    ok = (nq > 0) & F.when(F.col(purpose) == "DECISION", np_ > 0).otherwise(np_ == 0)
    return full.select(*expected.columns, nq.alias("quotes"), np_.alias("predictions"), ok.alias("complete"))


def latest_snapshot(snapshots: DataFrame, games: DataFrame, quotes: DataFrame, now, keys: str = "snapshot_id") -> DataFrame:
    """Newest complete decision snapshot that still prices a future game."""
    future = games.filter(F.col("kickoff_utc") > now).select("game_id")
    live = quotes.join(future, "game_id", "left_semi").select(keys)
    ok = snapshots.filter((F.col("snapshot_purpose") == "DECISION") & (F.col("status") == "COMPLETE") & (F.col("retrieved_at_utc") <= now))
    return ok.join(live, keys, "left_semi").orderBy(F.col("retrieved_at_utc").desc(), keys).limit(1)
