"""Epoch features, robust scaling and stress rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import arrays, text, timing
from tidewatch.functions.quantiles import exact_quantiles


def bucket_counts(events: DataFrame, epoch_seconds: int, buckets: int) -> DataFrame:
    """Sparse counts per client, epoch and hash bucket (``n`` all records, ``n_benign`` benign).

    Raw events are combined map-side per (client, epoch, type), so a busy client shrinks to its
    epochs and types before anything moves, and each type is hashed per group, not per event.
    """
    typed = (
        events.select(
            "client_id",
            timing.epoch_index(F.col("ts_seconds"), epoch_seconds).alias("epoch"),
            "event_type",
            (F.col("gt_class") == "benign").cast("long").alias("b"),
        )
        .groupBy("client_id", "epoch", "event_type")
        .agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    )
    return (
        typed.withColumn("bucket", text.hash_bucket(F.col("event_type"), buckets))
        .groupBy("client_id", "epoch", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("b").alias("n_benign"))
    )


def dense_counts(sparse: DataFrame, count: str, buckets: int) -> DataFrame:
    """One row per client epoch with its counts as an array of ``buckets`` entries."""
    filled = sparse.filter(F.col(count) > 0)
    slots = [F.sum(F.when(F.col("bucket") == b, F.col(count)).otherwise(0)) for b in range(buckets)]
    return filled.groupBy("client_id", "epoch").agg(F.array(*slots).alias("counts"))


def feature_columns(factor: float = 1.0) -> list:
    """log1p counts + total + entropy from ``counts``; ``factor`` multiplies counts and total."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    nlogn = F.aggregate(
        "counts",
        F.lit(0.0),
        lambda a, x: a + F.when(x > 0, x * F.log(F.greatest(x, F.lit(1)).cast("double"))).otherwise(F.lit(0.0)),
    )
    entropy = F.when(total > 0, F.greatest(F.log(F.greatest(total, F.lit(1)).cast("double")) - nlogn / total, F.lit(0.0))).otherwise(F.lit(0.0))
    logs = F.transform("counts", lambda x: F.log1p(x.cast("double") * F.lit(factor)))
    return [
        total.alias("total"),
        entropy.alias("entropy"),
        F.concat(logs, F.array(total * F.lit(factor), entropy)).alias("features"),
    ]


def epoch_features(dense: DataFrame, factor: float = 1.0) -> DataFrame:
    return dense.select("client_id", "epoch", *feature_columns(factor))


def common_interval(dense: DataFrame, clients: DataFrame) -> DataFrame:
    """One row (start, end): the latest first and the earliest last epoch over all clients.

    No interval when a client has no epoch or the end lies before the start.
    """
    per_client = clients.select("client_id").join(
        dense.groupBy("client_id").agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")), "client_id", "left"
    )
    return (
        per_client.agg(
            F.max("lo").alias("start_epoch"),
            F.min("hi").alias("end_epoch"),
            F.count_if(F.col("lo").isNull()).alias("empty"),
        )
        .filter((F.col("empty") == 0) & (F.col("end_epoch") >= F.col("start_epoch")))
        .select("start_epoch", "end_epoch")
    )


def dense_grid(dense: DataFrame, clients: DataFrame, interval: DataFrame, buckets: int) -> DataFrame:
    """Every client and epoch of the interval, zeros for empty epochs, with position ``pos``.

    The grid has one row per selected client and epoch and is generated, not collected.
    """
    span = interval.select(
        "start_epoch",
        (F.col("end_epoch") - F.col("start_epoch") + 1).alias("epochs"),
        F.explode(F.sequence("start_epoch", "end_epoch")).alias("epoch"),
    )
    ids = clients.agg(F.array_sort(F.collect_set("client_id"))).scalar()  # selected clients only
    grid = span.withColumn("ids", ids).select(
        F.explode("ids").alias("client_id"), "epoch", (F.col("epoch") - F.col("start_epoch")).alias("pos"), "epochs"
    )
    zeros = F.array_repeat(F.lit(0).cast("long"), buckets)
    return grid.join(dense, ["client_id", "epoch"], "left").withColumn("counts", F.coalesce("counts", zeros))


def non_finite_rows(features: DataFrame, column: str = "features") -> DataFrame:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return features.agg(F.count("*").alias("rows"), F.count_if(bad).alias("non_finite"))


def require_finite(features: DataFrame, column: str = "features") -> DataFrame:
    """Fail the job on the first non-finite value; nothing is imputed."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    guarded = F.when(bad, F.raise_error(F.lit("non-finite epoch feature"))).otherwise(F.col(column))
    return features.withColumn(column, guarded)


def fit_scaler(rows: DataFrame) -> DataFrame:
    """Median and inter-quartile range per client and feature of the given rows."""
    long = rows.select("client_id", F.posexplode("features").alias("feature", "value"))
    return exact_quantiles(long, ["client_id", "feature"], "value", (0.25, 0.5, 0.75)).select(
        "client_id", "feature", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")
    )


def scaler_arrays(scaler: DataFrame) -> DataFrame:
    """One row per client with aligned arrays: as many values as features."""
    packed = scaler.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("feature", "median", "iqr"))).alias("s"))
    return packed.select("client_id", F.col("s.median").alias("medians"), F.col("s.iqr").alias("iqrs"))


def apply_scaler(rows: DataFrame, scaler: DataFrame, floor: float) -> DataFrame:
    """``(x - median) / max(iqr, floor)``; the scaler has one row per selected client."""
    joined = rows.join(scaler_arrays(scaler), "client_id")
    centred = F.zip_with("features", "medians", lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("iqrs"), lambda x, q: x / F.greatest(q, F.lit(floor)))
    return joined.withColumn("scaled", scaled).drop("medians", "iqrs")


def distance_score(rows: DataFrame) -> DataFrame:
    """Root mean square of the scaled features: a score that needs no fitted model."""
    return rows.withColumn("score", F.sqrt(arrays.total(F.transform("scaled", lambda x: x * x)) / F.size("scaled")))
