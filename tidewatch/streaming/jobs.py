"""Structured Streaming twins of the sequential tail.

Epochs must reach a recursion in order, so stateful jobs buffer per key until the watermark has
passed an epoch. A replayed table ends with a closing marker, so its last epochs, windows and sessions
come out too; a replay that would lose rows behind the watermark fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewatch.functions import text
from tidewatch.operators.contexts import histogram_bin
from tidewatch.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: time of the closing marker, near the end of what nanoseconds express
END = "2262-01-01 00:00:00"


def event_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Stream of a parquet table, be it one file or a folder of part files.

    Spark takes a plain path for a folder; as a pattern that matches nothing else it may be either.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def _run(stream: DataFrame, out: str, marks: str) -> None:
    """One pass over everything available; rows dropped as too late are an error."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    late = sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])
    if late:
        raise ValueError(f"{late} rows came later than the watermark and were dropped")


def _marker(schema: StructType, ts: str) -> list:
    """Columns of the closing marker: the last time, empty texts, zeros."""
    values = {ts: F.lit(END)}
    return [values.get(f.name, F.lit("" if f.dataType.typeName() == "string" else 0)).cast(f.dataType).alias(f.name) for f in schema]


def drain(stream: DataFrame, name: str, job: Callable[[DataFrame], DataFrame] = lambda s: s, ts: str | None = None) -> DataFrame:
    """Run ``job`` on a stream over everything available into a parquet table and return the table.

    With ``ts``, the event time of a job that holds rows back, the run goes on with one marker row at :data:`END`
    from the same checkpoint. It moves the watermark past all data. The marker's own window, session or position
    stays behind the watermark, so it never comes out.
    """
    spark = stream.sparkSession
    out, marks = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    if ts is None:
        result = job(stream)
        _run(result, out, marks)
        return spark.read.schema(result.schema).parquet(out)
    closing = fresh_path(spark, f"{name}-closing")
    marker = spark.range(1).select(*_marker(stream.schema, ts))
    marker.limit(0).write.parquet(closing)
    result = job(stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing)))
    _run(result, out, marks)
    marker.write.mode("append").parquet(closing)
    _run(result, out, marks)
    return spark.read.schema(result.schema).parquet(out)


def epoch_counts(events: DataFrame, ts: str, epoch_seconds: int, buckets: int, delay: str) -> DataFrame:
    """Tumbling counts per (epoch, client, bucket), emitted once the watermark passes the epoch."""
    window = F.window(ts, f"{epoch_seconds} seconds")
    return (
        events.withWatermark(ts, delay)
        .groupBy(window.alias("w"), "client_id", text.hash_bucket(F.col("event_type"), buckets).alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select(
            F.floor(F.unix_seconds("w.start") / epoch_seconds).cast("long").alias("epoch"), "client_id", "bucket", "n"
        )
    )


def distinct_events(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """First copy of each identifier within the lateness bound; older state is forgotten."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["uid"])


def reference_bins(reference: DataFrame, bins: int) -> DataFrame:
    """Per client: reference count per score bin of [0, 1] as arrays of fixed length."""
    binned = reference.select("client_id", histogram_bin(F.col("score"), bins).alias("b"))
    counts = [F.count_if(F.col("b") == i) for i in range(bins)]
    return binned.groupBy("client_id").agg(F.array(*counts).alias("counts"), F.count("*").alias("n"))


def online_ranks(stream: DataFrame, reference: DataFrame, bins: int) -> DataFrame:
    """Midrank of streaming scores against a fixed binned reference (a stream-static join)."""
    joined = stream.join(reference, "client_id")
    b = histogram_bin(F.col("score"), bins)
    less = F.aggregate(F.slice("counts", 1, b), F.lit(0).cast("long"), lambda a, x: a + x)
    rank = (less + F.get("counts", b) * 0.5 + 0.5) / (F.col("n") + 1)
    return joined.withColumn("rank", rank).drop("counts", "n")


def stress_counts(events: DataFrame, ts: str, length_seconds: int, stride_seconds: int, delay: str) -> DataFrame:
    """Sliding window totals of the federation."""
    window = F.window(ts, f"{length_seconds} seconds", f"{stride_seconds} seconds")
    return (
        events.withWatermark(ts, delay)
        .groupBy(window.alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.unix_seconds("w.start").alias("start_second"), "n")
    )


def malicious_sessions(events: DataFrame, ts: str, gap_seconds: int, delay: str) -> DataFrame:
    """Runs of malicious records of a client, closed by a silent gap."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("w"), "client_id")
        .agg(F.count("*").alias("records"))
        .select(F.unix_micros("w.start").alias("start_micros"), F.unix_micros("w.end").alias("end_micros"), "client_id", "records")
    )


class _InOrder(StatefulProcessor):
    """Buffers rows of a key by position and hands them on in order once the watermark allows."""

    BUFFER = "pos long, value double"
    STATE = "value double, stop long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "pos long", "at long, value double")
        self.state = handle.getValueState("state", self.STATE)

    def advance(self, value: float, stop: int | None, pos: int, x: float) -> tuple[float, int | None]:
        raise NotImplementedError

    def row(self, key: tuple, pos: int, value: float, stop: int | None) -> dict:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for pos, at, value in zip(pdf["pos"], pdf["at_ms"], pdf["value"], strict=True):
                self.buffer.updateValue((int(pos),), (int(at), float(value)))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k[0], v[1]) for k, v in self.buffer.iterator() if v[0] <= now)
        if not ready:
            yield pd.DataFrame()
            return
        held = self.state.get() if self.state.exists() else None
        value, stop = (held[0], held[1]) if held else (0.0, None)
        out = []
        for pos, x in ready:
            value, stop = self.advance(value, stop, pos, x)
            out.append(self.row(key, pos, value, stop))
            self.buffer.removeKey((pos,))
        self.state.update((value, stop))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _recursion(threshold: float):
    class GlobalRecursion(_InOrder):
        def advance(self, value, stop, pos, x):
            value = (value + 1.0) * x
            return value, pos if stop is None and value >= threshold else stop

        def row(self, key, pos, value, stop):
            return {"key": key[0], "pos": pos, "state": value, "stop": stop}

    return GlobalRecursion()


def _walk(center: float, drift: float):
    class Cusum(_InOrder):
        def advance(self, value, stop, pos, x):
            return max(0.0, value + x - center - drift), stop

        def row(self, key, pos, value, stop):
            return {"key": key[0], "pos": pos, "state": value, "stop": stop}

    return Cusum()


def _persist(threshold: float, m: int, n: int):
    """The value holds the last ``n`` exceedances as bits, so the state has a fixed size."""

    class Persistence(_InOrder):
        def advance(self, value, stop, pos, x):
            bits = ((int(value) << 1) | int(x >= threshold)) & ((1 << n) - 1)
            return float(bits), pos if stop is None and bits.bit_count() >= m else stop

        def row(self, key, pos, value, stop):
            return {"key": key[0], "pos": pos, "state": float(int(value).bit_count()), "stop": stop}

    return Persistence()


def _stateful(stream: DataFrame, processor: StatefulProcessor, delay: str) -> DataFrame:
    """``stream`` has ``key string, pos long, at timestamp, value double``."""
    marked = stream.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return marked.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType="key string, pos long, state double, stop long",
        outputMode="Append",
        timeMode="EventTime",
    )


def online_recursion(stream: DataFrame, threshold: float, delay: str) -> DataFrame:
    return _stateful(stream, _recursion(threshold), delay)


def online_cusum(stream: DataFrame, center: float, drift: float, delay: str) -> DataFrame:
    return _stateful(stream, _walk(center, drift), delay)


def online_persistence(stream: DataFrame, threshold: float, m: int, n: int, delay: str) -> DataFrame:
    return _stateful(stream, _persist(threshold, m, n), delay)
