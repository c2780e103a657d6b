"""Scans, schema checks, file audit and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import timing
from tidewatch.session import spread

BOM = "﻿"


def _clean_name(name: str) -> str:
    return name.lstrip(BOM).strip()


def _scan_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", quote='"', escape='"', multiLine=False)
    frame = raw.toDF(*[_clean_name(c) for c in raw.columns])
    missing = missing_columns(frame.columns, required)
    if missing:
        raise ValueError(f"{path} lacks required columns {missing}")
    return frame


def scan_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Network-flow records as text columns; a missing required column fails at plan time."""
    return _scan_csv(spark, path, P.FLOW_REQUIRED)


def scan_packet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Packet records; every dotted protocol column keeps its literal name."""
    return _scan_csv(spark, path, P.PACKET_REQUIRED)


def scan_event_table(spark: SparkSession, path: str, client: Column, attack: Column) -> DataFrame:
    """A parquet event table as flow records. Only the columns used reach the scan."""
    return spark.read.parquet(path).select(
        F.col("event_id").alias("original_order"),
        F.col("event_id").cast("string").alias("uid"),
        client.alias("client_id"),
        timing.naive_seconds(F.col("ts")).alias("ts_seconds"),
        F.col("event_type"),
        F.col("props").alias("payload"),
        attack.cast("int").alias("binary_label"),
        F.when(attack, F.col("event_type")).otherwise(F.lit("normal")).alias("attack_type"),
    )


def missing_columns(observed: list[str], required: tuple[str, ...]) -> list[str]:
    names = {_clean_name(c) for c in observed}
    return [c for c in required if c not in names]


def schema_state(frame: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: READY or Invalid and the missing columns; metadata only, no data is read."""
    missing = missing_columns(frame.columns, required)
    spark = frame.sparkSession
    return spark.range(1).select(
        F.lit("READY" if not missing else "Invalid").alias("state"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(len(frame.columns)).cast("long").alias("observed_columns"),
    )


def map_columns(frame: DataFrame, documented: dict[str, str]) -> DataFrame:
    """Select documented fields from observed columns: ``{documented: observed}``."""
    absent = [d for d, o in documented.items() if o not in {_clean_name(c) for c in frame.columns}]
    if absent:
        raise ValueError(f"documented fields {absent} are missing from the observed schema")
    by_name = {_clean_name(c): c for c in frame.columns}
    return frame.select(*[F.col(f"`{by_name[o]}`").alias(d) for d, o in documented.items()])


def _open(uri: str):
    """Byte stream of a listed path, local or on any file system pyarrow knows."""
    if uri.startswith("file:"):
        return open(f"/{unquote(uri).removeprefix('file:').lstrip('/')}", "rb")
    from pyarrow import fs

    store, location = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(location)


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests, sizes = [], []
        for uri in batch["path"]:
            digest, size = hashlib.sha256(), 0
            with _open(uri) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
                    size += len(block)
            digests.append(digest.hexdigest())
            sizes.append(size)
        yield pd.DataFrame({"path": batch["path"].map(unquote), "sha256": digests, "bytes": sizes})


def file_inventory(spark: SparkSession, folder: str, name_filter: str = "*") -> DataFrame:
    """Path, SHA-256 and size of every file below a folder, empty ones included.

    Only names come from the file index. Each task streams its files in one-megabyte blocks, so a
    file of any size needs constant memory.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter).load(folder)
    )
    names = spark.createDataFrame([(p,) for p in listed.inputFiles()], "path string")
    return spread(names, "path").mapInPandas(_hash_files, "path string, sha256 string, bytes long")


def write_table(frame: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink; the rows of one output partition value may be spread over many tasks."""
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("escape", '"').csv(path, header=True)
