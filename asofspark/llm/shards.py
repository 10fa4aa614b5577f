"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's id picks one of 4,096 virtual slots for good. Bytes are summed per
slot, and a map gives each slot a shard so that the shards' bytes are near
equal. Only the map changes when shards come or go: each version is one small
written table, and growing moves slots into the new shard alone. The map has as
many rows as there are slots, whatever the input, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from asofspark.llm.common import checkpointed, column_of, text_of
from asofspark.session import shared_dir

SLOT_DIGITS = 3
"""Hexadecimal digits of the id's digest that name a slot."""
N_SLOTS = 16**SLOT_DIGITS
RECORD_OVERHEAD = 8


def slot_of(record_id: Column, checksum: Column) -> Column:
    """The virtual slot of an id; a null id is dealt out by its text's checksum."""
    digest = F.md5(F.coalesce(record_id.cast("string"), F.concat(F.lit("null "), checksum)))
    return F.conv(F.substring(digest, 1, SLOT_DIGITS), 16, 10).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot; text itself stays at the scan."""
    body = text_of(docs, text)
    checksum = F.crc32(body.cast("binary"))
    return docs.select(
        column_of(docs, id_col).alias("doc_id"),
        (F.octet_length(body) + RECORD_OVERHEAD).cast("bigint").alias("size"),
        checksum.alias("text_crc32"),
        slot_of(column_of(docs, id_col), checksum).alias("vslot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """vslot, bytes and rows of the slots in use."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def initial_map(usage: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots from the largest on, each to the shard with the fewest bytes so far.

    Ties go to the smaller slot and the smaller shard. The fold runs over one
    array of at most ``N_SLOTS`` slots; slots not in use follow with no bytes.
    """
    every = usage.sparkSession.range(N_SLOTS).select(F.col("id").cast("int").alias("vslot"))
    full = every.join(usage, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    queue = full.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("queue"))
    chosen = F.aggregate(
        "queue",
        F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"), F.array().cast("array<int>").alias("picks")),
        _pick,
        lambda acc: acc["picks"],
    )
    placed = queue.select(F.explode(F.arrays_zip(F.col("queue"), chosen.alias("picks"))).alias("p"))
    return placed.select(F.lit(1).alias("version"), F.col("p.queue.vslot").alias("vslot"), F.col("p.picks").alias("shard"), (-F.col("p.queue.less")).alias("bytes"))


def _pick(acc: Column, slot: Column) -> Column:
    at = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
    loads = F.transform(acc["loads"], lambda load, i: F.when(i == at, load - slot["less"]).otherwise(load))
    return F.struct(loads.alias("loads"), F.concat(acc["picks"], F.array(at)).alias("picks"))


def grow(current: DataFrame, usage: DataFrame) -> DataFrame:
    """The next version, with one more shard: slots move into it only.

    Every old shard gives up its smallest slots (ties: smaller slot first) as
    long as what it has given stays within an (n + 1)-th of its bytes.
    """
    shards = current.agg((F.max("shard") + 1).alias("n"))
    now = current.select("version", "vslot", "shard").join(usage.select("vslot", "bytes"), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))
    in_shard = Window.partitionBy("shard")
    given = F.sum("bytes").over(in_shard.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("bytes").over(in_shard)
    n = shards.select("n").scalar()
    moved = now.withColumn("moves", given * (n + 1) <= total)
    return moved.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.col("moves"), n).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes")


def store_map(slot_map: DataFrame, name: str) -> DataFrame:
    """Write one version of a map as ``<shared folder>/shard_maps/<name>/version=n``; reads all versions back.

    A version that is there already is never written over.
    """
    folder = f"{shared_dir(slot_map.sparkSession)}/shard_maps/{name}"
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return slot_map.sparkSession.read.parquet(folder)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, counted from 0 without gaps.

    Places run through the virtual slots of a shard in order, and by id, checksum
    and size within a slot: ranks are taken per virtual slot and shifted by the
    row counts of the slots before, so no shard is sorted in one task.
    """
    counts = records.groupBy("vslot").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("vslot", "shard").join(counts, "vslot").select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("rank", rank).join(F.broadcast(starts), "vslot").withColumn("slot", F.col("start") + F.col("rank"))


def shard_documents(docs: DataFrame, shards: int, name: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard per document.

    The law is ``bytes``. Null texts count the record overhead alone; null ids
    are dealt out by checksum; rows that repeat an id share a virtual slot, ranked
    by checksum and size. Equal rows all appear, each with a place of its own.
    Other columns are not read. An empty table gives no rows.
    """
    records = checkpointed(sized(docs))
    slot_map = store_map(initial_map(slot_bytes(records), shards), name)
    placed = place(records, slot_map)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
