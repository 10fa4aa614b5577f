"""Keyed state with event-time timers: ordered line movement and closing quotes.

Rows of a contract wait in state until the watermark has passed them and leave in
order of time, so rows that come late, but within the watermark's delay, are put where they
belong; what comes after that is refused and marked as late. State is dropped when the
contract closes. Results are appended once and never rewritten.

Contracts are dealt to ``BUCKETS`` state keys by hash. A call of Python and its round trips to the
state store then serve all contracts of a bucket, whose rows are one Arrow table in state, so
their number follows the buckets and batches, not the contracts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 128
"""State keys of an operator; the same for the life of a checkpoint."""


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that timers need; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


class _Bucket(StatefulProcessor):
    """State of a bucket: tables of rows, and one timer for the earliest row that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.timer = handle.getValueState("timer", T.StructType(_longs("at")))

    def _load(self, state) -> list[pd.DataFrame]:
        """The table in a list, or nothing."""
        return [pa.ipc.open_stream(state.get()[0]).read_pandas()] if state.exists() else []

    def _store(self, state, rows: pd.DataFrame) -> None:
        if rows.empty:
            state.clear()
            return
        told = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, told.schema) as out:
            out.write_table(told)
        state.update((sink.getvalue().to_pybytes(),))

    def _wait_for(self, micros: int) -> None:
        at = int(micros) // 1000 + 1
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class OrderedMovement(_Bucket):
    """State of a bucket: the last emitted (time, line) of its contracts, and the rows that the watermark has not passed."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows), ignore_index=True)
        # what has been emitted lies before the watermark, so no row that is taken precedes it
        taken = (new["at"] < new["closes"]) & (new["closes"] > mark) & (new["at"] >= mark)
        new = new[[*self.keys, "at", "line"]]
        late, new = new[~taken], new[taken]
        if len(new):
            self._store(self.rows, pd.concat([*self._load(self.rows), new], ignore_index=True))
            self._wait_for(new["at"].min())
        if len(late):
            yield late.assign(previous_line=float("nan"), late=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        for waiting in self._load(self.rows):
            ready, rest = waiting[waiting["at"] < mark], waiting[waiting["at"] >= mark]
            self._store(self.rows, rest)
            if len(rest):
                self._wait_for(rest["at"].min())
            if ready.empty:
                continue
            every = pd.concat([x.assign(late=old) for old, x in [*((True, x) for x in self._load(self.last)), (False, ready)]], ignore_index=True)
            every["_contract"] = every.groupby(self.keys, dropna=False, sort=False).ngroup()
            every = every.sort_values(["_contract", "at", "line"], kind="stable", ignore_index=True)
            contract = every.groupby("_contract", sort=False)
            every["previous_line"] = contract["line"].shift()
            self._store(self.last, contract.tail(1)[[*self.keys, "at", "line"]])
            yield every.loc[~every["late"], [*self.keys, "at", "line", "previous_line", "late"]]


class ClosingQuote(_Bucket):
    """State of a bucket: the best row so far of its open contracts. It leaves when the contract closes."""

    def __init__(self, keys: list[str], payload: list[str]):
        self.keys, self.payload = keys, payload

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows), ignore_index=True)
        new = new.loc[new["closes"] > mark, [*self.keys, "at", "tie", "closes", *self.payload]]
        if len(new):
            every = pd.concat([*self._load(self.rows), new], ignore_index=True)
            every = every.sort_values(["at", "tie"], ascending=False, kind="stable")  # of equals the first that came
            self._store(self.rows, every.drop_duplicates(self.keys))
            self._wait_for(new["closes"].min())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        for waiting in self._load(self.rows):
            closed, rest = waiting[waiting["closes"] < mark], waiting[waiting["closes"] >= mark]
            self._store(self.rows, rest)
            if len(rest):
                self._wait_for(rest["closes"].min())
            if len(closed):
                yield closed[[*self.keys, "at", *self.payload]]


def _bucketed(rows: DataFrame, keys: list[str], carried: list[str]) -> tuple[DataFrame, list[T.StructField]]:
    """Rows with their bucket, and the fields of ``carried``. Whole numbers are carried as text: beside a null, pandas would make them doubles."""
    whole = [f.name for f in rows.schema if f.name in carried and isinstance(f.dataType, T.IntegralType)]
    told = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).withColumns({c: F.col(c).cast("string") for c in whole})
    return told, [told.schema[c] for c in carried]


def ordered_movement(quotes: DataFrame, keys: list[str], ts: str, line: str, closes: Column | None = None, delay: str = "30 minutes") -> DataFrame:
    """Change of the line against the contract's previous quote, in order of (time, line).

    Rows come out once the watermark has passed them. A row that comes after its time has been
    emitted, or at or after ``closes``, is refused: it comes out with ``late`` true and no
    previous line. Without ``closes`` a contract's last quote is kept for good.
    """
    never = F.lit(2**62).cast("bigint")
    told = quotes.withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(F.col(ts)).alias("at"), F.col(line).cast("double").alias("line"),
        (never if closes is None else F.unix_micros(closes)).alias("closes"),
    )
    dealt, fields = _bucketed(told, keys, keys)
    schema = T.StructType([*fields, *T.StructType.fromDDL("at bigint, line double, previous_line double, late boolean").fields])
    out = dealt.groupBy("bucket").transformWithStateInPandas(OrderedMovement(keys), schema, "Append", "EventTime")
    return out.select(
        *[F.col(k).cast(told.schema[k].dataType).alias(k) for k in keys],
        F.timestamp_micros("at").alias(ts), F.col("line").alias(line), "previous_line", (F.col("line") - F.col("previous_line")).alias("line_movement"), "late",
    )


def closing_quote(quotes: DataFrame, keys: list[str], ts: str, closes: Column, payload: list[str], tie: str, delay: str = "30 minutes") -> DataFrame:
    """The latest quote of every contract, appended once when the watermark passes ``closes``; later rows are refused."""
    least = F.lit(-(2**63)).cast("bigint")
    told = quotes.withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(F.col(ts)).alias("at"), F.coalesce(F.col(tie).cast("bigint"), least).alias("tie"), F.unix_micros(closes).alias("closes"), *payload
    )
    dealt, fields = _bucketed(told, keys, [*keys, *payload])
    schema = T.StructType([*fields[: len(keys)], *_longs("at"), *fields[len(keys) :]])
    out = dealt.groupBy("bucket").transformWithStateInPandas(ClosingQuote(keys, payload), schema, "Append", "EventTime")
    back = {c: F.col(c).cast(told.schema[c].dataType).alias(c) for c in (*keys, *payload)}
    return out.select(*[back[k] for k in keys], F.timestamp_micros("at").alias(ts), *[back[p] for p in payload])
