import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofspark.operators import market as mk
from asofspark.operators.ledger import Ledger
from asofspark.sources import readers as rd
from asofspark.streaming import quotes as st
from asofspark.streaming import stateful as stf
from asofspark.streaming import upsert as ups

T0 = datetime(2026, 9, 13, 12)


def land(spark, path, rows, schema):
    """One file per row group, so the stream takes several micro-batches."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def test_boards_stream_to_the_batch_quotes(spark, tmp_path):
    for i in range(3):
        market = {"key": "totals", "last_update": "2026-09-13T11:50:00Z", "outcomes": [{"name": "Over", "point": 44.5, "price": -110 - i}, {"name": "Under", "point": 44.5, "price": -110}]}
        board = [{"id": f"e{i}", "commence_time": "2026-09-13T17:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "pinnacle", "title": "P", "last_update": None, "markets": [market]}]}]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"b{i}.json").write_text(json.dumps(board))
    src = str(tmp_path / "in")
    quotes = st.quote_stream(st.board_stream(spark, src, 1))
    st.drain(quotes, str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = mk.flatten_board(rd.read_boards(spark, src))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect()) == sorted(batch.collect())


def test_ledger_sink_survives_a_replayed_batch(spark, tmp_path):
    schema = "id string, value double"
    land(spark, str(tmp_path / "in"), [[("a", 1.0)], [("b", 2.0), ("a", 1.0)]], schema)
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    book = Ledger(str(tmp_path / "l"), df.schema, ("id",), ())
    sink = st.ledger_sink(book)
    st.drain_batches(stream(spark, str(tmp_path / "in"), df.schema), sink, str(tmp_path / "ck"))
    sink(spark.createDataFrame([("a", 1.0)], schema), 0)  # the same batch id again
    assert sorted((r["id"], r["value"]) for r in book.read(spark).collect()) == [("a", 1.0), ("b", 2.0)]


def test_one_capture_per_key(spark, tmp_path):
    schema = "key string, t timestamp"
    rows = [[("x", T0), ("y", T0)], [("x", T0 + timedelta(hours=1))], [("z", T0 + timedelta(hours=2)), ("y", T0)]]
    land(spark, str(tmp_path / "in"), rows, schema)
    st.drain(st.once_per_key(stream(spark, str(tmp_path / "in"), schema), ["key"], "t"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]


def test_consensus_per_micro_batch(spark, tmp_path):
    schema = (
        "snapshot_id string, provider_event_id string, market string, selection string, bookmaker_key string, canonical_line double, vig_free_probability double, "
        "retrieved_at_utc timestamp, source_updated_at_utc timestamp"
    )
    def q(snap, book, line):
        return (snap, "e", "spreads", "HOME", book, line, 0.5, T0, T0)

    parts = [[q("s1", "pinnacle", 3.0), q("s1", "fanduel", 3.0), q("s1", "betmgm", 3.0)], [q("s2", "pinnacle", 3.0), q("s2", "fanduel", 3.5), q("s2", "betmgm", 3.5)]]
    land(spark, str(tmp_path / "in"), parts, schema)
    body = st.per_batch(mk.consensus, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"))
    st.drain_batches(stream(spark, str(tmp_path / "in"), schema), body, str(tmp_path / "ck"))
    got = {r["snapshot_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"s1": "VALID", "s2": "INCOMPARABLE_POINTS"}


def feed(spark, tmp_path, schema, parts, start):
    """Lands part after part and runs the stream to its end after each; state lives in the checkpoint."""
    own = stf.stateful_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(own.readStream.schema(schema).parquet(str(tmp_path / "in")))


def test_ordered_movement_corrects_late_rows_and_refuses_later_ones(spark, tmp_path):
    schema = "k string, t timestamp, line double, closes timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    end = at(300)
    parts = [
        [("a", at(0), 1.0, end), ("b", at(1), 5.0, end), ("a", at(20), 3.0, end)],
        [("a", at(10), 2.0, end), ("a", at(20), 2.5, end), ("b", at(60), 6.0, end)],  # late, but within the delay; equal times
        [("a", at(5), 9.0, end), ("a", at(90), 4.0, end), ("a", at(299), 8.0, end)],  # refused: emitted beyond it
        [("a", at(301), 7.0, end), ("z", at(900), 0.0, at(9000))],  # refused: closed
        [("z", at(2000), 0.0, at(9000))],
    ]
    start = lambda s: st.drain(
        stf.ordered_movement(s, ["k"], "t", "line", F.col("closes"), "30 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    feed(spark, tmp_path, schema, parts, start)
    got = sorted((r.k, r.t, r.line, r.previous_line, r.late) for r in spark.read.parquet(str(tmp_path / "out")).filter("k <> 'z'").collect() if not r.late)
    a = [(0, 1.0), (10, 2.0), (20, 2.5), (20, 3.0), (90, 4.0), (299, 8.0)]
    expected = [("a", at(m), v, a[i - 1][1] if i else None, False) for i, (m, v) in enumerate(a)]
    assert got == expected + [("b", at(1), 5.0, None, False), ("b", at(60), 6.0, 5.0, False)]
    late = [(r.k, r.t, r.previous_line) for r in spark.read.parquet(str(tmp_path / "out")).filter("late").collect()]
    assert set(late) <= {("a", at(5), None), ("a", at(301), None)} and ("a", at(301), None) in late


def test_closing_quote_comes_out_once(spark, tmp_path):
    schema = "k string, start timestamp, t timestamp, n bigint, v double"
    kick = T0 + timedelta(hours=5)
    at = lambda m: kick - timedelta(minutes=m)
    parts = [
        [("a", kick, at(100), 1, 1.0), ("a", kick, at(60), 2, 2.0)],
        [("a", kick, at(30), 3, 4.0), ("a", kick, at(30), 4, 5.0), ("b", kick, at(80), 5, 6.0)],
        [("z", kick + timedelta(days=9), T0 + timedelta(days=2), 6, 0.0)],
        [("a", kick, at(20), 7, 9.0), ("z", kick + timedelta(days=9), T0 + timedelta(days=3), 8, 0.0)],  # after the close: refused
    ]
    closes = F.col("start") - F.expr("INTERVAL 5 MINUTES")
    start = lambda s: st.drain(stf.closing_quote(s, ["k", "start"], "t", closes, ["v"], "n"), str(tmp_path / "out"), str(tmp_path / "ck"))
    feed(spark, tmp_path, schema, parts, start)
    got = sorted((r.k, r.t, r.v) for r in spark.read.parquet(str(tmp_path / "out")).filter("k <> 'z'").collect())
    assert got == [("a", at(30), 5.0), ("b", at(80), 6.0)]


def test_weekly_quota_by_update_into_a_keyed_sink(spark, tmp_path):
    schema = "k string, t timestamp"
    sink = ups.UpsertSink(str(tmp_path / "out"), ("bucket",))
    parts = [[("a", T0), ("a", T0 + timedelta(hours=1))], [("b", T0 + timedelta(hours=2)), ("c", T0 + timedelta(days=20))]]
    feed(spark, tmp_path, schema, parts, lambda s: st.drain_batches(st.weekly_counts(s, "t", "America/Toronto", 3), sink, str(tmp_path / "ck"), "update"))
    want = [(3, True), (1, False)]
    assert [(r.captures, r.quota_reached) for r in sink.read(spark).orderBy("bucket").collect()] == want
    first = spark.read.parquet(str(tmp_path / "out" / "delta-000000000000"))
    sink(spark.createDataFrame(first.collect(), first.schema), 0)  # a repeated batch id changes nothing
    assert [(r.captures, r.quota_reached) for r in sink.read(spark).orderBy("bucket").collect()] == want
    sink.compact(spark)
    sink.compact(spark)
    assert [(r.captures, r.quota_reached) for r in sink.read(spark).orderBy("bucket").collect()] == want


def test_freshness_rule_on_a_stream(spark, tmp_path):
    schema = "id int, retrieved_at_utc timestamp, source_updated_at_utc timestamp"
    rows = [(i, T0, None if a is None else T0 - timedelta(minutes=a)) for i, a in enumerate([0, 30, 31, -1, None])]
    land(spark, str(tmp_path / "in"), [rows], schema)
    st.drain(st.fresh_quotes(stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_table_stream_reads_files_and_folders(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS k").repartition(4)
    df.write.parquet(f"{tmp_path}/folder.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file.parquet")
    for name in ("folder", "file"):
        stream = st.table_stream(spark, f"{tmp_path}/{name}.parquet", df.schema)
        st.drain(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/ck-{name}")
        assert spark.read.schema(df.schema).parquet(f"{tmp_path}/out-{name}").count() == 100
    with pytest.raises(FileNotFoundError):
        st.table_stream(spark, f"{tmp_path}/none.parquet", df.schema)


def test_contracts_share_the_state_keys_of_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stf, "BUCKETS", 2)
    schema, big = "k bigint, t timestamp, n bigint, line double", 2**60 + 1  # no double holds these ids
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(big + i, at(m), big + m, float(m + i)) for i in range(200) for m in (20, 0)]
    parts = [rows, [(None, at(2000), None, 0.0)]]
    end, told = F.lit(at(60)), []

    def run(name, out):
        def start(s):
            made = stf.ordered_movement(s, ["k"], "t", "line") if name == "moved" else stf.closing_quote(s, ["k"], "t", F.when(F.col("k").isNull(), at(9000)).otherwise(end), ["n", "line"], "n")
            q = made.writeStream.format("parquet").option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start(f"{out}/out")
            q.awaitTermination()
            told.append(q.recentProgress[0]["stateOperators"][0]["numRowsTotal"])
        return start

    for name in ("moved", "closed"):
        (tmp_path / name).mkdir()
        feed(spark, tmp_path / name, schema, parts, run(name, tmp_path / name))
    got = spark.read.parquet(f"{tmp_path}/moved/out").select("k", "t", "line", "previous_line", "late").filter("k IS NOT NULL").collect()
    assert sorted(got, key=lambda r: r[:2]) == [(big + i, at(m), float(m + i), None if m == 0 else float(i), False) for i in range(200) for m in (0, 20)]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/closed/out").collect()) == [(big + i, at(20), big + 20, 20.0 + i) for i in range(200)]
    assert max(told) <= 20  # a few values a bucket, not a contract
