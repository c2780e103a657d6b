"""Session settings and durable stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` must be storage that every executor reaches, so a stage written
    there survives lost executors. Only where it is unset (tests) a local folder is made.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-tidewatch-", dir="/tmp")
        _ROOTS[app] = f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex[:12]}"
    return _ROOTS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition into the configured number of shuffle partitions.

    Adaptive execution sizes partitions by bytes. Where few bytes fan out into many rows or feed
    heavy Python work, that leaves a handful of tasks; an explicit count is kept as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a parquet stage and read it back: lineage ends at the table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
