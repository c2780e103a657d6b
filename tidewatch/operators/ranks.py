"""Marginal and conditional midranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import prefix
from tidewatch.functions.arrays import clip


def marginal_ranks(scores: DataFrame, reference: DataFrame, epsilon: float, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Clipped midrank ``rank`` of every score within its client's reference scores."""
    table = prefix.midrank_table(reference, scores, list(keys), "score", prefix.magnitude_bucket("score"))
    return scores.join(table, [*keys, "score"]).withColumn(
        "rank", clip(F.col("midrank"), epsilon, 1.0 - epsilon)
    ).drop("midrank")


def conditional_rank_table(rows: DataFrame, is_reference: Column) -> DataFrame:
    """Midranks of marginal ranks inside (coalition, cell, member slot).

    ``rows`` has ``coalition_id, cell, u`` (``u`` = marginal ranks of the members); the rows that
    satisfy ``is_reference`` are counted, all are ranked, in one pass. Ranks lie in [0, 1], so
    equal-width buckets spread them.
    """
    long = rows.select("coalition_id", "cell", is_reference.cast("long").alias("w"), F.posexplode("u").alias("slot", "value"))
    return prefix.weighted_midranks(long, ["coalition_id", "cell", "slot"], "value", "w", prefix.unit_bucket("value", 16))


def conditional_ranks(rows: DataFrame, table: DataFrame, max_order: int, epsilon: float) -> DataFrame:
    """Array ``r`` of conditional ranks per coalition epoch; rows keep their shape (one join per slot).

    Spark broadcasts the table when its measured size is small and otherwise co-partitions by key.
    """
    out = rows
    for slot in range(max_order):
        part = table.filter(F.col("slot") == slot).select(
            F.col("coalition_id"), "cell", F.col("value").alias(f"_v{slot}"), F.col("midrank").alias(f"_m{slot}")
        )
        out = out.withColumn(f"_v{slot}", F.get("u", F.lit(slot))).join(part, ["coalition_id", "cell", f"_v{slot}"], "left")
    ranks = F.array(*[clip(F.col(f"_m{s}"), epsilon, 1.0 - epsilon) for s in range(max_order)])
    out = out.withColumn("r", F.slice(ranks, 1, F.size("u")))
    return out.drop(*[f"_v{s}" for s in range(max_order)], *[f"_m{s}" for s in range(max_order)])
