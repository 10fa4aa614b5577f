"""Streaming forms of the board and quote operators.

They reuse the batch functions, so a stream run to its end gives the batch
result on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.fixed_values import FRESHNESS_MINUTES
from asofspark.functions.scalars import local_week_start
from asofspark.operators import market as mk
from asofspark.operators.ledger import Ledger
from asofspark.sources.readers import BOARD


def board_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Landed board files as a stream, one row per event."""
    reader = spark.readStream.schema(BOARD).option("multiLine", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select(
        "*", F.col("_metadata.file_name").alias("snapshot_id"), F.col("_metadata.file_modification_time").alias("retrieved_at_utc")
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A parquet table as a stream, whether one file or a folder of part files.

    A file source watches folders, so a single file is streamed from its parent,
    filtered by name. The file system of the path decides which it is.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise FileNotFoundError(f"no table at {path}")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if files.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def quote_stream(boards: DataFrame, books: mk.Books = mk.Books()) -> DataFrame:
    """Boards to priced quotes; stateless."""
    return mk.flatten_board(boards, books)


def fresh_quotes(quotes: DataFrame, minutes: int = FRESHNESS_MINUTES) -> DataFrame:
    """Freshness as a row rule; the watermark only bounds state downstream."""
    kept = quotes.filter(mk.fresh("source_updated_at_utc", "retrieved_at_utc", minutes))
    return kept.withWatermark("source_updated_at_utc", f"{minutes} minutes")


def once_per_key(captures: DataFrame, key: list[str], ts: str, delay: str = "8 days") -> DataFrame:
    """First capture of an idempotency key; state is dropped after ``delay``."""
    return captures.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def weekly_counts(captures: DataFrame, ts: str, zone: str, limit: int, keys: list[str] | None = None, delay: str = "1 day") -> DataFrame:
    """Captures per local Tuesday week and whether the quota is reached.

    The weeks are event-time windows over local time, so in update mode a week's
    state goes once the watermark has passed its end.
    """
    local = captures.withColumn("_local", F.from_utc_timestamp(F.col(ts), zone)).withWatermark("_local", delay)
    week = F.window("_local", "7 days", startTime="5 days")  # the epoch fell on a Thursday
    return local.groupBy(week.alias("_week"), *(keys or [])).agg(
        F.count(F.lit(1)).alias("captures"), (F.count(F.lit(1)) >= limit).alias("quota_reached")
    ).select(F.to_date("_week.start").alias("bucket"), *(keys or []), "captures", "quota_reached")


def per_batch(transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: a batch operator applied to each micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(transform(batch), batch_id)

    return run


def ledger_sink(ledger: Ledger, prefix: str = "batch") -> Callable[[DataFrame, int], None]:
    """Append each micro-batch to a ledger; a repeated batch id does nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ledger.append(batch, f"{prefix}-{batch_id}")

    return run


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Run a stream over everything available and stop."""
    stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def drain_batches(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.foreachBatch(body).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
