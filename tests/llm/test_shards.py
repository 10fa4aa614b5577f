import uuid
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from asofspark.llm import shards


NAME = uuid.uuid4().hex


def frame(spark, n=700):
    rows = [(i, "wörd " * (i * i % 97), "x") for i in range(n)] + [(None, "no id", "x"), (None, None, "x"), (5, "wörd " * 25, "x"), (5, None, "x"), (6, "", "x"), (6, "", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_contract(spark):
    rows, df = frame(spark)
    got = shards.shard_documents(df, 24, NAME + "-contract").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(24))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_growing_moves_slots_into_the_new_shard_only(spark):
    _, df = frame(spark)
    usage = shards.slot_bytes(shards.sized(df))
    first = shards.store_map(shards.initial_map(usage, 4), NAME + "-grow")
    assert first.count() == shards.N_SLOTS
    second = shards.grow(first.filter("version = 1"), usage)
    both = shards.store_map(second, NAME + "-grow")
    assert {r.version for r in both.select("version").distinct().collect()} == {1, 2}
    a, b = both.filter("version = 1").alias("a"), both.filter("version = 2").alias("b")
    moved = a.join(b, "vslot").filter("a.shard <> b.shard")
    assert moved.filter("b.shard <> 4").count() == 0
    loads = [r.s for r in both.filter("version = 2").groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
    assert len(loads) == 5 and min(loads) > 0.9 * max(loads)


def test_empty_table(spark):
    assert shards.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 24, NAME + "-empty").count() == 0
