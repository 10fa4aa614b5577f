"""Registered queries: the event table as a stream, drained and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from asofspark.catalog.bindings import table
from asofspark.operators import market as mk
from asofspark.session import shared_dir
from asofspark.streaming import quotes as st
from asofspark.streaming import stateful as stf
from asofspark.streaming import upsert as ups

_ZONE = "America/Toronto"


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = st.table_stream(spark, f"{sf_dir}/events.parquet", schema)
    # event-time operators need an instant: the table's naive times are UTC
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _place(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _naive(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _drained(spark, stream):
    place = _place(spark)
    st.drain(stream, f"{place}/out", f"{place}/ck")
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def _slices(spark, sf_dir, parts=4):
    """The event table as it might land: slices by arrival, up to 20 minutes after the event, then a last row far ahead that moves the watermark past all."""
    ev = table(spark, sf_dir, "events")
    arrival = F.col("ts") + F.make_interval(mins=F.expr("CAST(event_id % 21 AS INT)"))
    first, last = ev.agg(F.min(arrival), F.max(arrival)).first()
    step = (last - first) / parts
    for i in range(parts):
        until = last if i == parts - 1 else first + (i + 1) * step
        yield ev.filter((arrival <= F.lit(until)) & ((arrival > F.lit(first + i * step)) if i else F.lit(True)))
    ahead = ev.orderBy("event_id").limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (F.lit(last) + F.expr("INTERVAL 90 DAYS")).alias("ts") for f in ev.schema])
    yield ahead


def _landed(spark, sf_dir, start):
    """Lands slice after slice and drains the stream after each, so state lives through checkpoints and restarts.

    ``start(stream, place)`` starts a query over the stream and waits for it.
    """
    place = _place(spark)
    own = stf.stateful_session(spark)
    schema = table(spark, sf_dir, "events").schema
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(f"{place}/in")
        stream = own.readStream.schema(schema).parquet(f"{place}/in")
        start(stream.withColumn("ts", F.col("ts").cast("timestamp")), place)
    return place


def stream_quotes(spark, sf_dir):
    """Stateless line orientation and freshness over the stream."""
    ev = _events(spark, sf_dir)
    updated = F.col("ts") - F.make_interval(mins=F.expr("CAST(event_id % 50 - 5 AS INT)"))
    q = ev.withColumns({"source_updated_at_utc": updated, "retrieved_at_utc": F.col("ts")})
    fresh = st.fresh_quotes(q).select("event_id", "user_id", "retrieved_at_utc", "source_updated_at_utc")
    return _naive(_drained(spark, fresh), "retrieved_at_utc", "source_updated_at_utc")


def stream_once_per_key(spark, sf_dir):
    keyed = _events(spark, sf_dir).select("user_id", "event_type", "ts")
    return _drained(spark, st.once_per_key(keyed, ["user_id", "event_type"], "ts", "40 days")).select("user_id", "event_type")


def stream_weekly_counts(spark, sf_dir):
    """Update mode into a keyed sink that is written once per batch id."""
    keys = ("bucket", "event_type")

    def start(stream, place):
        counts = st.weekly_counts(stream.filter("event_id IS NOT NULL"), "ts", _ZONE, 450, ["event_type"])
        st.drain_batches(counts, ups.UpsertSink(f"{place}/out", keys), f"{place}/ck", "update")

    out = ups.UpsertSink(f"{_landed(spark, sf_dir, start)}/out", keys).read(spark)
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def stream_latest_in_window(spark, sf_dir):
    """The closing quote of every contract, appended once when it closes."""
    def start(stream, place):
        begin = F.date_trunc("DAY", "ts") + F.expr("INTERVAL 1 DAY")
        quotes = stream.withColumn("start", begin).filter(mk.in_close_window("start", "ts", 5, 720) | F.col("event_id").isNull())
        closing = stf.closing_quote(quotes, ["user_id", "start"], "ts", F.col("start") - F.expr("INTERVAL 299 SECONDS"), ["event_id", "value"], "event_id")
        st.drain(closing.filter("event_id IS NOT NULL"), f"{place}/out", f"{place}/ck")

    place = _landed(spark, sf_dir, start)
    return _naive(spark.read.parquet(f"{place}/out"), "start", "ts")


def stream_line_movement(spark, sf_dir):
    """Movement against the previous quote of a contract, over several batches with late rows."""
    def start(stream, place):
        moved = stf.ordered_movement(stream, ["user_id", "event_type"], "ts", "value")
        st.drain(moved.filter("user_id IS NOT NULL"), f"{place}/out", f"{place}/ck")

    out = _naive(spark.read.parquet(f"{_landed(spark, sf_dir, start)}/out"), "ts").withColumnRenamed("value", "line")
    return out.withColumn("line_movement", F.round("line_movement", 6))


QUERIES = {
    "stream_quotes": stream_quotes,
    "stream_once_per_key": stream_once_per_key,
    "stream_weekly_counts": stream_weekly_counts,
    "stream_latest_in_window": stream_latest_in_window,
    "stream_line_movement": stream_line_movement,
}
ORACLES = {
    "stream_quotes": """SELECT event_id, user_id, ts AS retrieved_at_utc, ts - to_minutes(CAST(event_id % 50 - 5 AS INT)) AS source_updated_at_utc
      FROM events WHERE event_id % 50 - 5 BETWEEN 0 AND 30""",
    "stream_once_per_key": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_weekly_counts": """SELECT strftime(CAST(ts - INTERVAL 5 HOUR AS DATE) - CAST((isodow(ts - INTERVAL 5 HOUR) + 5) % 7 AS INT), '%Y-%m-%d') AS bucket,
      event_type, count(*) AS captures, count(*) >= 450 AS quota_reached FROM events GROUP BY 1, 2""",
    "stream_latest_in_window": """SELECT user_id, start, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY ts DESC, event_id DESC) AS rn
      FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS start FROM events) e
      WHERE date_diff('microsecond', ts, start) / 60000000e0 BETWEEN 5 AND 720) x WHERE rn = 1""",
    "stream_line_movement": """SELECT user_id, event_type, ts, value AS line, lag(value) OVER w AS previous_line, round(value - lag(value) OVER w, 6) + 0e0 AS line_movement, false AS late
      FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, value)""",
}
