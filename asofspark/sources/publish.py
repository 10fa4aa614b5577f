"""Writers: partitioned parquet, canonical CSV/JSON and versioned publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.functions.scalars import content_hash, dataset_digest
from asofspark.operators.checks import profile


class ChecksFailed(ValueError):
    """Staged data did not pass; nothing was published."""


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Zstandard parquet with few files per partition folder.

    The rebalance hint gathers each folder's rows and splits a folder that
    holds a large share of all rows over many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """A whole table as header CSV in canonical order (range-sorted, part by part)."""
    df.orderBy(*order).write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Report rows as JSON lines or CSV."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def _stage(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write to a folder that no earlier run has used; returns what was written and the folder's name."""
    folder = f"versions/{version}-{uuid.uuid4().hex}"
    write_parquet(df, f"{path}/{folder}", partition_by)
    return df.sparkSession.read.parquet(f"{path}/{folder}"), folder


def _refuse(failing: list) -> None:
    if failing:
        raise ChecksFailed("; ".join(f"{r['table']}.{r['check_id']}: {r['violations']}" for r in failing))


def _facts(staged: DataFrame) -> DataFrame:
    return staged.select(content_hash(staged).alias("content_hash")).agg(F.count(F.lit(1)).alias("rows"), dataset_digest().alias("digest"))


def publish(
    df: DataFrame,
    path: str,
    version: str,
    partition_by: list[str] | None = None,
    checks: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Write a folder of its own, check what was written, then name it current.

    Readers follow the manifest, whose row is written last; a failed check or
    a lost job leaves the earlier data in place, also where a version is
    published again.
    """
    staged, folder = _stage(df, path, version, partition_by)
    if checks is not None:
        _refuse(checks(staged).filter("violations > 0").collect())
    _facts(staged).select(
        F.lit(version).alias("version"), F.lit(folder).alias("folder"), "rows", "digest", F.current_timestamp().alias("published_at")
    ).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return staged


def publish_all(tables: dict[str, DataFrame], path: str, version: str, checks: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    """Stage several tables, check them together, then publish all of them in one row.

    Any failing check, or a job lost before that row, leaves every table at its
    earlier version.
    """
    staged = {name: _stage(df, f"{path}/{name}", version) for name, df in tables.items()}
    _refuse(checks({name: df for name, (df, _) in staged.items()}).filter("violations > 0").collect())
    facts = None
    for name, (df, folder) in staged.items():
        one = _facts(df).select(F.struct(F.lit(name).alias("name"), F.lit(folder).alias("folder"), "rows", "digest").alias("t"))
        facts = one if facts is None else facts.unionByName(one)
    facts.agg(F.collect_list("t").alias("tables")).select(
        F.lit(version).alias("version"), "tables", F.current_timestamp().alias("published_at")
    ).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest published data of a table, whether published alone or together with its neighbours."""
    above, _, name = path.rstrip("/").rpartition("/")
    found = []
    if _exists(spark, f"{path}/manifest"):
        found.append(spark.read.parquet(f"{path}/manifest").select("folder", "version", "published_at"))
    if _exists(spark, f"{above}/manifest"):
        joint = spark.read.parquet(f"{above}/manifest")
        if "tables" in joint.columns:
            rows = joint.select("version", "published_at", F.inline("tables")).filter(F.col("name") == name)
            found.append(rows.select("folder", "version", "published_at"))
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    row = reduce(DataFrame.unionByName, found).agg(F.max_by("folder", F.struct("published_at", "version", "folder")).alias("f")).head()
    return spark.read.parquet(f"{path}/{row['f']}")


class CaptureConflict(ValueError):
    """A capture id that exists with other content."""


_CAPTURES = "capture_id string, dataset string, folder string, rows bigint, digest string, schema_hash string, available_at timestamp, captured_at timestamp"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The profile rows of every capture."""
    if not _exists(spark, f"{path}/_profile"):
        return spark.createDataFrame([], _CAPTURES)
    return spark.read.schema(_CAPTURES).parquet(f"{path}/_profile")


def capture(tables: dict[str, tuple[DataFrame, str]], path: str, capture_id: str, captured_at: Column | None = None) -> DataFrame:
    """Keep several sources under one capture id, with a profile row per dataset; a capture never changes.

    Each entry is (frame, availability time column or None). Data lie in a folder of
    their own and count once the profile rows are written, in one file, at the end. A
    capture id that exists is a repeat: the same content does nothing and returns the first
    profile, other content is refused (CaptureConflict).
    """
    spark = next(iter(tables.values()))[0].sparkSession
    known = {r["dataset"]: r["digest"] for r in captures(spark, path).filter(F.col("capture_id") == capture_id).select("dataset", "digest").collect()}
    if known:
        differ = sorted(set(known) ^ set(tables)) + [n for n, (df, _) in tables.items() if n in known and _facts(df).head()["digest"] != known[n]]
        if differ:
            raise CaptureConflict(f"capture {capture_id} exists with other content of {differ}")
        return captures(spark, path).filter(F.col("capture_id") == capture_id)
    rows = None
    for name, (df, available) in tables.items():
        stored, folder = _stage(df, f"{path}/{name}", "capture")
        signature = ",".join(f"{n}:{t}" for n, t in sorted(stored.dtypes))
        latest = stored.agg((F.max(available).cast("timestamp") if available else F.lit(None).cast("timestamp")).alias("available_at"))
        row = _facts(stored).select(
            F.lit(capture_id).alias("capture_id"), F.lit(name).alias("dataset"), F.lit(folder).alias("folder"), "rows", "digest",
            F.sha2(F.lit(signature), 256).alias("schema_hash"), latest.scalar().alias("available_at"),
            (F.current_timestamp() if captured_at is None else captured_at.cast("timestamp")).alias("captured_at"),
        )
        rows = row if rows is None else rows.unionByName(row)
    rows.coalesce(1).write.mode("append").parquet(f"{path}/_profile")
    return captures(spark, path).filter(F.col("capture_id") == capture_id)


def as_known_at(spark: SparkSession, path: str, dataset: str, keys: list[str], known: Column, event_time: str | None = None, until: Column | None = None) -> DataFrame:
    """A dataset as it was known at a time: per key the row of the latest capture taken by then.

    With ``event_time`` and ``until``, of those rows the ones whose event lies no later: both times are cut on
    their own. Captures taken later are not opened.
    """
    taken = captures(spark, path).filter((F.col("dataset") == dataset) & (F.col("captured_at") <= known.cast("timestamp")))
    rows = None
    for r in taken.select("folder", "capture_id", F.unix_micros("captured_at").alias("at")).orderBy("at", "capture_id").collect():
        part = spark.read.parquet(f"{path}/{dataset}/{r['folder']}").withColumn("_known", F.struct(F.lit(r["at"]).alias("a"), F.lit(r["capture_id"]).alias("c")))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise FileNotFoundError(f"no capture of {dataset} was taken by then")
    rest = [c for c in rows.columns if c not in (*keys, "_known")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_known").alias("_r")).select(*keys, "_r.*")
    return latest.filter(F.col(event_time) <= until) if event_time and until is not None else latest


def dataset_profile(df: DataFrame, name: str) -> DataFrame:
    return profile(df, name)
