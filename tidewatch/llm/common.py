"""Tables, sizes and result columns that several operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: registered queries of this subpackage and the SQL of those that SQL can express
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bytes_of(df: DataFrame) -> int:
    """The planner's size of a table; for files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(df: DataFrame, each: int) -> int:
    """How many groups keep ``each`` bytes of the table apiece, at least one per shuffle partition.

    Where the planner knows no size (it then assumes a huge one), the texts are measured.
    """
    size = bytes_of(df)
    if size > 1 << 55:
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), math.ceil(size / each))


def remainder(doc_id: str, n: int):
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def batches_of(schema: pa.Schema, rows: dict[str, list]) -> pa.RecordBatch:
    """One record batch with the schema's columns and types."""
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
