"""Chronological partitions, horizons and stress windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import prefix
from tidewatch.functions.binomial import minimum_horizons


def assign_partitions(grid: DataFrame, fractions: tuple[float, float, float]) -> DataFrame:
    """Role of each epoch from its position: floors of three fractions, the rest is held out.

    A dense grid already knows its position, so no ordering is needed.
    """
    if sum(fractions) > 1.0 + 1e-12:
        raise ValueError("partition fractions exceed the common interval")
    first, second, third = (F.floor(F.lit(f) * F.col("epochs")).cast("long") for f in fractions)
    pos = F.col("pos")
    role = (
        F.when(pos < first, P.PARTITIONS[0])
        .when(pos < first + second, P.PARTITIONS[1])
        .when(pos < first + second + third, P.PARTITIONS[2])
        .otherwise(P.PARTITIONS[3])
    )
    start = (
        F.when(pos < first, F.lit(0))
        .when(pos < first + second, first)
        .when(pos < first + second + third, first + second)
        .otherwise(first + second + third)
    )
    size = (
        F.when(pos < first, first)
        .when(pos < first + second, second)
        .when(pos < first + second + third, third)
        .otherwise(F.col("epochs") - first - second - third)
    )
    return grid.withColumn("partition", role).withColumn("part_pos", pos - start).withColumn("part_size", size)


def assign_horizons(parted: DataFrame, length: int) -> DataFrame:
    """Non-overlapping blocks from each partition start; an incomplete last block is dropped."""
    block = F.floor(F.col("part_pos") / length).cast("long")
    return (
        parted.withColumn("horizon_id", block)
        .withColumn("h_pos", (F.col("part_pos") % length).cast("long"))
        .filter((F.col("horizon_id") + 1) * length <= F.col("part_size"))
    )


def horizon_eligibility(horizons: DataFrame, target: float, confidence: float) -> DataFrame:
    """Complete horizons per partition against the number a zero-stop calibration needs."""
    required = minimum_horizons(target, confidence)
    epochs = horizons.select("partition", "horizon_id", "epoch").distinct()
    return (
        epochs.groupBy("partition")
        .agg(
            F.count_distinct("horizon_id").alias("horizons"),
            (F.count("*") == F.count_distinct("epoch")).alias("non_overlapping"),
        )
        .withColumn("required", F.lit(required).cast("long"))
        .withColumn("claim_state", F.when(F.col("horizons") < required, "NOT_TESTED").otherwise("SUPPORTED"))
    )


def stress_windows(epoch_totals: DataFrame, length: int, stride: int, top_fraction: float) -> DataFrame:
    """Sliding windows over dense epochs ranked by their total count; boundary ties are kept.

    ``epoch_totals`` has ``epoch`` and ``total``. A window sum is the difference of two running
    sums, and the cut is found on distinct sums, so nothing is ordered in a single task.
    """
    ran = prefix.running_sums(epoch_totals, [], ["epoch"], prefix.time_chunk("epoch"), {"cum": "total"})
    first = epoch_totals.agg(F.min("epoch")).scalar()
    before = ran.select((F.col("epoch") + length).alias("epoch"), F.col("cum").alias("cum_before"))
    sums = (
        ran.join(before, "epoch", "left")
        .withColumn("first", first)
        .select(
            (F.col("epoch") - (length - 1)).alias("start_epoch"),
            F.col("epoch").alias("end_epoch"),
            (F.col("cum") - F.coalesce("cum_before", F.lit(0))).alias("window_total"),
            "first",
        )
        .filter((F.col("start_epoch") >= F.col("first")) & ((F.col("start_epoch") - F.col("first")) % stride == 0))
        .drop("first")
    )
    distinct = sums.groupBy("window_total").agg(F.count("*").alias("same")).withColumn("down", -F.col("window_total"))
    ranked = prefix.running_sums(distinct, [], ["down"], prefix.time_chunk("down"), {"upto": "same"}, whole=True)
    keep = ranked.filter(F.col("upto") - F.col("same") < F.ceil(F.lit(top_fraction) * F.col("upto_all")))
    return sums.join(keep.select("window_total"), "window_total", "left_semi")
