"""Streams over tables of one file and of part files, to their last row."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import jobs


@pytest.fixture
def events(spark):
    ts = F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts")
    return spark.range(90).select(ts, F.concat(F.lit("h"), F.col("id") % 3).alias("client_id"), F.lit("dns").alias("event_type"))


def _counts(stream):
    return jobs.epoch_counts(stream, "ts", 3600, 4, "10 minutes")


@pytest.mark.parametrize("parts", [1, 5])
def test_counts_of_part_files_are_whole(spark, events, tmp_path, parts):
    events.repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    stream = jobs.event_stream(spark, str(tmp_path), "events.parquet", events.schema)
    rows = jobs.drain(stream, "counts-of-parts", _counts, "ts").collect()
    assert sum(r["n"] for r in rows) == 90
    assert {r["client_id"] for r in rows} == {"h0", "h1", "h2"}
    assert max(r["epoch"] for r in rows) == (89 * 600 + 1_700_000_000) // 3600


def test_counts_of_one_file(spark, events, tmp_path):
    events.coalesce(1).write.parquet(str(tmp_path / "folder"))
    next((tmp_path / "folder").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    stream = jobs.event_stream(spark, str(tmp_path), "events.parquet", events.schema)
    assert jobs.drain(stream, "counts-of-file", _counts, "ts").agg(F.sum("n")).first()[0] == 90


def test_late_rows_fail(spark, events, tmp_path):
    """Three files in three batches, the older rows last; Spark judges a batch by the watermark before the last one."""
    path, new = str(tmp_path / "events.parquet"), F.col("ts") >= F.timestamp_seconds(F.lit(1_700_040_000))
    first = F.col("client_id") == "h0"
    for part in (new & first, new & ~first, ~new):
        events.filter(part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files come in order of their times
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(ValueError, match="later than the watermark"):
        jobs.drain(stream, "late", _counts, "ts")
