"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofspark.operators.schedule import union_slices


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, where: Column | str | None = None) -> DataFrame:
    """Header CSV under a fixed schema; ``where`` is pushed into the scan.

    A header that differs from the schema is an error, not a silent shift.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.filter(where) if where is not None else df


def read_seasons(spark: SparkSession, path: str, first_season: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Season-partitioned parquet; the season bound prunes partitions.

    Slices whose columns drifted are merged by name.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    if first_season is not None:
        df = df.filter(F.col("season") >= first_season)
    return df.select(*columns) if columns else df


OUTCOME = T.StructType([T.StructField("name", T.StringType()), T.StructField("point", T.DoubleType()), T.StructField("price", T.IntegerType())])
MARKET = T.StructType([T.StructField("key", T.StringType()), T.StructField("last_update", T.TimestampType()), T.StructField("outcomes", T.ArrayType(OUTCOME))])
BOOKMAKER = T.StructType(
    [
        T.StructField("key", T.StringType()), T.StructField("title", T.StringType()), T.StructField("last_update", T.TimestampType()),
        T.StructField("markets", T.ArrayType(MARKET)),
    ]
)
BOARD = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("commence_time", T.TimestampType()), T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()), T.StructField("bookmakers", T.ArrayType(BOOKMAKER)),
    ]
)


def read_boards(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Captured board files (a JSON array per file) with their file and landing time."""
    df = spark.read.schema(BOARD).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    return df.select("*", F.col("_metadata.file_name").alias("snapshot_id"), F.col("_metadata.file_modification_time").alias("retrieved_at_utc"))


def parse_boards(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Board text columns to one row per event."""
    parsed = F.from_json(F.col(payload), T.ArrayType(BOARD), {"mode": "FAILFAST"})
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.inline(parsed))


def read_key(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """Rows of one key; a partition column prunes folders, any other is pushed down."""
    return spark.read.parquet(path).filter(F.col(column) == value)


def ingest(slices: dict[int, DataFrame], columns: dict[str, str], season: str = "season") -> DataFrame:
    """Season slices cast to a declared superset and stacked.

    Absent columns become null, so a drifting provider cannot change the type
    of a column.
    """
    parts = []
    for year, df in sorted(slices.items()):
        have = set(df.columns)
        parts.append(
            df.select(
                *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items() if c != season],
                F.lit(year).cast(columns.get(season, "int")).alias(season),
            )
        )
    return union_slices(parts)


def availability(landed: DataFrame, datasets: dict[str, bool], seasons: list[int], errors: DataFrame | None = None) -> DataFrame:
    """AVAILABLE, EMPTY, ERROR or NOT_AVAILABLE per expected (dataset, season).

    ``landed`` has one row per landed file (dataset, season, rows);
    ``datasets`` maps a name to whether it is required. The expected grid is
    built from the two short literal lists.
    """
    spark = landed.sparkSession
    expected = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("dataset"), F.lit(r).alias("required")) for n, r in datasets.items()]))
    ).select("*", F.explode(F.array(*[F.lit(s) for s in seasons])).alias("season"))
    found = landed.groupBy("dataset", "season").agg(F.sum("rows").alias("rows"))
    out = expected.join(found, ["dataset", "season"], "left")
    if errors is not None:
        out = out.join(errors.select("dataset", "season", F.lit(True).alias("_error")).distinct(), ["dataset", "season"], "left")
    else:
        out = out.withColumn("_error", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("_error"), F.lit("ERROR"))
        .when(F.col("rows").isNull(), F.lit("NOT_AVAILABLE"))
        .when(F.col("rows") == 0, F.lit("EMPTY"))
        .otherwise(F.lit("AVAILABLE"))
    )
    return out.select(
        "dataset", "season", "required", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"),
        (F.col("required") & (status != "AVAILABLE")).alias("blocking"),
    )
