"""Registered queries over what sources, sinks and ledgers have written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from asofspark.catalog.bindings import r6, rounded, table
from asofspark.operators import checks as ck
from asofspark.operators.ledger import Ledger
from asofspark.session import shared_dir
from asofspark.sources import publish as pb
from asofspark.sources import readers as rd


def _place(spark) -> str:
    return f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))


def ledger_appends(spark, sf_dir):
    """Runs that overlap and one that repeats: every key once, opened by bucket and period."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "season", "o_custkey", "o_totalprice")
    book = Ledger(_place(spark), rows.schema, ("o_orderkey", "season"), (), period="season")
    done = [
        ("a", book.append(rows.filter("season <= 1997"), "a")),
        ("b", book.append(rows.filter("season BETWEEN 1997 AND 1999"), "b")),
        ("b again", book.append(rows, "b")),
        ("c", book.append(rows.filter("season >= 1999"), "c")),
    ]
    counts = spark.createDataFrame([(r, n["inserted"], n["unchanged"]) for r, n in done], "run string, inserted bigint, unchanged bigint")
    held = book.read(spark).agg(F.count(F.lit(1)).alias("held_rows"), F.sum("o_totalprice").alias("held_total"))
    return rounded(counts.withColumns({"held_rows": held.select("held_rows").scalar(), "held_total": F.round(held.select("held_total").scalar(), 2)}))


def published_versions(spark, sf_dir):
    """Two published versions and one that its checks refuse: readers stay at the second."""
    place, orders = f"{_place(spark)}/orders", _orders(spark, sf_dir)
    checks = lambda df: ck.check_bundle(df, "orders", {"price_missing": F.col("o_totalprice").isNull()})
    pb.publish(orders.filter("season <= 1997"), place, "v1", ["season"], checks)
    pb.publish(orders.filter("season <= 1999"), place, "v2", ["season"], checks)
    refused = 0
    try:
        pb.publish(orders.withColumn("o_totalprice", F.when(F.col("season") < 2000, F.col("o_totalprice"))), place, "v3", ["season"], checks)
    except pb.ChecksFailed:
        refused = 1
    now = pb.current(spark, place)
    return rounded(now.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(refused).alias("refused")))


def season_reads(spark, sf_dir):
    """Partitioned seasons read from one season on and for one alone; CSV and JSON read with declared types."""
    place, orders = _place(spark), _orders(spark, sf_dir)
    pb.write_parquet(orders, f"{place}/orders", ["season"])
    since = rd.read_seasons(spark, f"{place}/orders", 1995)
    one = rd.read_key(spark, f"{place}/orders", "season", 1996)
    nation = table(spark, sf_dir, "nation")
    pb.write_csv(nation, f"{place}/nation", ["n_nationkey"])
    text = rd.read_csv(spark, f"{place}/nation", nation.schema, "n_regionkey > 1")
    pb.write_report(nation, f"{place}/report")
    report = spark.read.schema(nation.schema).json(f"{place}/report")
    parts = [
        since.groupBy("season").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("since "), F.col("season")).alias("read"), "n"),
        one.agg(F.lit("only 1996").alias("read"), F.count(F.lit(1)).alias("n")),
        text.agg(F.lit("csv").alias("read"), F.sum("n_nationkey").alias("n")),
        report.agg(F.lit("json").alias("read"), F.sum(F.length("n_name")).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("read", F.col("n").cast("bigint").alias("n"))


def known_at(spark, sf_dir):
    """Sums per user as they were known in between three captures; a repeated capture does nothing, a changed one is refused."""
    place, events = _place(spark), table(spark, sf_dir, "events")
    def state(day):
        seen = events.filter(F.col("ts") < F.lit(day).cast("timestamp_ntz"))
        return seen.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))

    days = ["2024-01-11", "2024-01-16", "2024-01-26"]
    for d in days:
        pb.capture({"users": (state(d), "last_ts")}, place, d, F.lit(d))
    pb.capture({"users": (state(days[1]), "last_ts")}, place, days[1])
    refused = 0
    try:
        pb.capture({"users": (state(days[2]), "last_ts")}, place, days[1])
    except pb.CaptureConflict:
        refused = 1
    seen = pb.as_known_at(spark, place, "users", ["user_id"], F.lit("2024-01-20"), "last_ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    return rounded(seen.withColumns({"refused": F.lit(refused), "captures": F.lit(pb.captures(spark, place).count())}))


QUERIES = {
    "ledger_appends": ledger_appends,
    "published_versions": published_versions,
    "season_reads": season_reads,
    "known_at": known_at,
}
ORACLES = {
    "ledger_appends": f"""WITH o AS (SELECT *, year(o_orderdate) AS season FROM orders), c AS (
        SELECT count(*) FILTER (season <= 1997) AS a, count(*) FILTER (season BETWEEN 1998 AND 1999) AS b, count(*) FILTER (season = 1997) AS ab,
          count(*) FILTER (season > 1999) AS c, count(*) FILTER (season = 1999) AS bc, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o)
      SELECT run, inserted, unchanged, n AS held_rows, {r6('total')} AS held_total FROM (
        SELECT 'a' AS run, a AS inserted, 0 AS unchanged, n, total FROM c UNION ALL SELECT 'b', b, ab, n, total FROM c
        UNION ALL SELECT 'b again', 0, b, n, total FROM c UNION ALL SELECT 'c', c, bc, n, total FROM c) x""",
    "published_versions": f"""SELECT CAST(year(o_orderdate) AS INT) AS season, count(*) AS rows, {r6('round(sum(o_totalprice), 2)')} AS total, 1 AS refused
      FROM orders WHERE year(o_orderdate) <= 1999 GROUP BY 1""",
    "season_reads": """SELECT 'since ' || year(o_orderdate) AS read, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 1
      UNION ALL SELECT 'only 1996', count(*) FROM orders WHERE year(o_orderdate) = 1996
      UNION ALL SELECT 'csv', CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey > 1
      UNION ALL SELECT 'json', CAST(sum(length(n_name)) AS BIGINT) FROM nation""",
    "known_at": f"""SELECT user_id, last_ts, events, {r6('total')} AS total, 1 AS refused, 3 AS captures FROM (
        SELECT user_id, max(ts) AS last_ts, count(*) AS events, round(sum(value), 6) AS total FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1) s
      WHERE last_ts <= TIMESTAMP '2024-01-15'""",
}
